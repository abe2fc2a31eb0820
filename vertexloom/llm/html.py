"""Main text of web pages by a site style tree.

Every page is parsed into blocks of text that hang on style paths (the tags and classes from the
body down). All pages of a host that differ are merged by style path: for each path the tree
keeps how many pages have it, how its children are laid out (presentation) and what its texts
say (content). The importance of a branch that holds text is made of the entropy of its texts
and, a tenth, that of the layouts of the branch around it, each over the logarithm of the
number of pages that have the path: what is the same on every page has none, what is new on
every page has all. Branches of low importance are removed from each page.

A host with few pages proves little, so the evidence is weighed against what the tags say:
``article`` and ``main`` have prior importance 1, all else a half, or a quarter beside a main
element. What the tags or whole class names call menus, footers, adverts, notices, forms or
comments has none and goes without evidence. A page that a host repeats counts once, so a
repeated article stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, read
from .urls import host_of

#: Pages of a host that weigh as much as the prior.
PRIOR_PAGES = 8
#: Branches below this importance are removed.
LEAST_IMPORTANCE = 0.4
#: What a branch's texts weigh in its importance; the layout around it weighs the rest.
CONTENT_WEIGHT = 0.9

_NAME = re.compile(r"[^\s/>]*")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Formulas are part of the line that they stand in.
MATH = frozenset("math semantics annotation annotation-xml mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd".split())
#: Elements that may close themselves by a slash, as may all within the first two.
CLOSES_ITSELF = frozenset("svg math object select option button canvas".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
NOISE_TAGS = frozenset("nav footer header aside form menu dialog head object svg select optgroup option button canvas annotation annotation-xml".split()) | RAW
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promos menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars "
    "footer masthead cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe signup login comment comments "
    "disqus replies respond share sharing social related recommended pagination pager toolbar widget widgets skip".split()
)
#: Words that a class name of noise may have besides: ``site-footer``, ``ad-slot``, ``related-posts``.
AROUND_NOISE = frozenset(
    "site page main top bottom left right upper lower header global primary secondary mobile desktop sticky fixed inner outer box container wrapper wrap area section block list item items "
    "bar slot unit zone panel links link buttons button icons form thread posts post articles stories content text message dialog row col column group holder".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))


class Block:
    """A block of text: its style path, what the tags say of it, its pieces."""

    __slots__ = ("path", "prior", "pieces")

    def __init__(self, path: int, prior: int):
        self.path, self.prior, self.pieces = path, prior, []


class Element:
    """An open element; ``block`` is the place in the stack of the nearest one that isn't inline."""

    __slots__ = ("tag", "path", "prior", "block")

    def __init__(self, tag: str, path: int, prior: int, block: int):
        self.tag, self.path, self.prior, self.block = tag, path, prior, block


def _is_noise(names: str) -> bool:
    """Whether one of the class names or ids is a name of noise, alone or among words that say where."""
    for name in names.split():
        parts = [p for p in _WORDS.findall(name)]
        if any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in AROUND_NOISE for p in parts):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; a comment or declaration has no name.

    One pass: a ``>`` in quotes doesn't end a tag, unless the quotes or the tag are never closed.
    A tag that the page's end cuts off has everything after it.
    """
    at, size, last = 0, len(page), page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        closing = page.startswith("/", at + 1)
        begin = at + 1 + closing
        letter = page[begin : begin + 1]
        if not (letter.isascii() and letter.isalpha()):
            if letter in ("!", "?") and not closing:
                end = page.find(">", begin)
                end = size if end < 0 else end + 1
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        if at > last:
            yield at, size, "", False, ""
            return
        name = _NAME.match(page, begin).end()
        end = name
        while m := _QUOTE_OR_END.search(page, end):
            if m.group() == ">":
                break
            end = page.find(m.group(), m.end()) + 1
            if not end:
                m = None
                break
        stop = m.start() if m else page.find(">", name)
        at_next = yield at, stop + 1, page[begin:name].lower(), closing, page[name:stop]
        at = stop + 1 if at_next is None else at_next


def _prior(tag: str, attributes: str, inherited: int) -> int:
    """0: noise, 1: main text, 2: open. Noise inside main text is noise, and stays it."""
    if inherited == 0:
        return 0
    # a header inside the article holds its title
    if tag in NOISE_TAGS and not (tag == "header" and inherited == 1):
        return 0
    if attributes:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return 0
        if tag not in ("body", "html") and not (tag in MAIN_TAGS and inherited == 2) and _is_noise(f"{found.get('class', '')} {found.get('id', '')}".lower()):
            return 0
        if found.get("role", "").lower() == "main":
            return 1
    return 1 if tag in MAIN_TAGS else inherited


def _style(tag: str, attributes: str) -> str:
    for k, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        if k.lower() == "class":
            return f"{tag}.{'.'.join(sorted((a or b or c).lower().split()))}"
    return tag


def _step(path: int, style: str) -> int:
    """The name of a style path one element longer: paths of any depth take eight bytes."""
    return xxhash.xxh3_64_intdigest(style, seed=path & 0xFFFFFFFFFFFFFFFF) >> 1


def blocks(page: str | None, layout: dict[int, list[int]] | None = None) -> list[tuple[int, int, str]]:
    """(style path, prior, text) of every block of text that the tags don't call noise.

    Prior 1 is main text, 2 is open, 3 open on a page that also has a main element: it lies
    beside the main text. White space inside a block becomes one space, references are decoded,
    empty blocks go. Unclosed and stray tags are borne; whatever lies in a raw element (script,
    style, ...) goes, and so do drawings, buttons and options; a formula's text stays. The work
    grows with the page's length, whatever its nesting. ``layout`` gets, for each style path, the
    styles of its children as they come.
    """
    if not page:
        return []
    out: list[Block] = []
    stack = [Element("", 0, 2, 0)]
    opened: dict[str, list[int]] = {}  # the places of the open elements of a tag
    current: Block | None = None
    at = 0

    def write(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if not text or top.prior == 0:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(stack[top.block].path, top.prior)
            out.append(current)
        current.pieces.append(text)

    def cut_to(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag].pop()
        del stack[k:]

    def nearest(tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    tags = _tags(page)
    found = next(tags, None)
    while found:
        start, end, tag, closing, attributes = found
        jump = None
        write(page[at:start])
        at = end
        if not tag:
            pass
        elif closing:
            k = nearest((tag,))
            if k:
                blocks_within = stack[-1].block > k or (tag not in INLINE)
                if tag in INLINE and stack[-1].block > k:
                    current = None  # an inline end tag doesn't close blocks around it
                else:
                    if blocks_within:
                        current = None
                    cut_to(k)
        elif attributes.endswith("/") and (tag in CLOSES_ITSELF or opened.get("svg") or opened.get("math")):
            current = current if tag in INLINE else None
        elif tag == "br":
            write(" ")
        else:
            if tag not in INLINE:
                current = None
                if tag in CLOSES_P:
                    # a block ends a drawing, a formula or an option that was left open
                    k = nearest(("svg", "math"))
                    if k and nearest(("foreignobject", "annotation-xml")) < k:
                        cut_to(k)
                    while stack[-1].tag in ("option", "optgroup") and not opened.get("select"):
                        cut_to(len(stack) - 1)
                    if opened.get("p") and stack[stack[-1].block].tag == "p":
                        cut_to(stack[-1].block)
                if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    k = nearest(("dt", "dd") if tag in ("dt", "dd") else (tag,))
                    if k and (tag == "tr" or nearest(("ul", "ol", "dl", "table", "tr", "select", "datalist")) < k):
                        cut_to(k)
            if tag in VOID:
                pass
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
                jump = at = close.end() if close else len(page)
            else:
                above = stack[-1]
                path = above.path
                if tag not in INLINE and tag not in ("html", "body"):
                    path = _step(path, _style(tag, attributes))
                    if layout is not None:
                        layout.setdefault(above.path, []).append(path)
                stack.append(Element(tag, path, _prior(tag, attributes, above.prior), above.block if tag in INLINE else len(stack)))
                opened.setdefault(tag, []).append(len(stack) - 1)
        try:
            found = next(tags) if jump is None else tags.send(jump)
        except StopIteration:
            found = None
    write(page[at:])
    beside = any(b.prior == 1 for b in out)
    done = []
    for b in out:
        text = _SPACE.sub(" ", entities.unescape("".join(b.pieces))).strip()
        if text:
            done.append((b.path, 3 if b.prior == 2 and beside else b.prior, text))
    return done


def main_text(page: str | None, odd: set[tuple[int, int]] | None = None) -> str:
    """The page's text, a line for each block: all but those beside the main text.

    ``odd`` has the (path, prior) of branches that the host's tree decides the other way. A page
    without a tree (None) keeps what lies beside, too.
    """
    return "\n".join(text for path, prior, text in blocks(page) if odd is None or (prior != 3) != ((path, prior) in odd))


#: Rows of branches that are sent on at once.
BRANCH_ROWS = 20_000


def branches(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, page, path, prior, parent, said, value, whole): every page's branches, each once.

    Where ``said``, ``value`` names what the branch's texts say, else how its children are laid
    out; a branch with both has two rows. ``page`` is a hash of the html, ``whole`` of all the
    texts of the branch's prior. ``parent`` is the path around one with texts, -1 for the body's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = lambda x: xxhash.xxh3_64_intdigest(x) >> 1
        columns = ["host", "page", "path", "prior", "parent", "said", "value", "whole"]
        for pdf in batches:
            out = []
            for host, page, text_of in zip(pdf["host"], pdf["page"], pdf["html"], strict=True):
                texts: dict[tuple[int, int], list[str]] = {}
                layout: dict[int, list[int]] = {}
                by_prior: dict[int, list[str]] = {}
                for path, prior, text in blocks(text_of, layout):
                    texts.setdefault((path, prior), []).append(text)
                    by_prior.setdefault(prior, []).append(text)
                whole = {prior: name("\n".join(said)) for prior, said in by_prior.items()}
                parent = {child: path for path, shape in layout.items() for child in shape}
                out += [(host, page, path, prior, parent.get(path, -1), True, name("\n".join(said)), whole[prior]) for (path, prior), said in texts.items()]
                out += [(host, page, path, 0, -1, False, name(",".join(map(str, shape))), page) for path, shape in layout.items()]
                if len(out) >= BRANCH_ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "host string, page long, path long, prior int, parent long, said boolean, value long, whole long")


def style_tree(seen: DataFrame) -> DataFrame:
    """Every host's branches with texts: (host, path, prior, pages, presentation, content), from ``branches``.

    ``content`` is the entropy of what the branch's texts say, ``presentation`` that of how the
    branch around it is laid out, from counts over all of the host's different pages, each in
    [0, 1]. Texts of the body itself have nothing around them, so no presentation.
    """
    # pages that say the same count once
    counts = seen.select("host", "path", "prior", "parent", "said", "value", "whole").distinct().groupBy("host", "path", "prior", "parent", "said", "value").agg(F.count("*").alias("n"))
    # entropy / log m = log m - sum(n log n) / m, over log m: sums that combine before the shuffle
    sums = counts.groupBy("host", "path", "prior", "parent", "said").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(0.5))
    texts = sums.where("said").select("host", "path", "prior", "parent", F.col("m").alias("pages"), entropy.alias("content"))
    layouts = sums.where("NOT said").select("host", F.col("path").alias("parent"), entropy.alias("presentation"))
    return texts.join(layouts, ["host", "parent"], "left").select("host", "path", "prior", "pages", "presentation", "content")


def importance() -> Column:
    """Evidence from the branch's pages against its prior importance.

    A branch is as important as its texts are diverse and the layout around it is varied.
    """
    content = F.col("content")
    seen = F.coalesce(CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * F.col("presentation"), content)
    evidence = (F.col("pages") - 1) / (F.col("pages") - 1 + PRIOR_PAGES)
    return evidence * seen + (1 - evidence) * F.when(F.col("prior") == 1, 1.0).when(F.col("prior") == 3, 0.25).otherwise(0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null and empty html gives an empty text. A null url, or one without ``://``, belongs to the
    host without a name. Repeated rows each get a row and count once in their host's tree. Pages
    of any length and depth are read whole. Ties have no part in it. Other columns aren't read,
    so their names cannot clash; an empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession)
    seen = scratch.save(branches(pages, url_col, html_col))
    # what lies beside a main element goes unless the tree finds it important, all else stays unless it doesn't
    odd = style_tree(seen).where((importance() >= least) == (F.col("prior") == 3)).select("host", "path", "prior")
    odd = scratch.save(odd)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"))
    if odd.limit(1).count():
        of_page = seen.where("said").join(scratch.small(odd), ["host", "path", "prior"]).groupBy("host", "page").agg(F.collect_set(F.struct("path", "prior")).alias("odd"))
        rows = rows.join(scratch.small(scratch.save(of_page), "shuffle_hash"), ["host", "page"], "left")
    else:
        rows = rows.withColumn("odd", F.lit(None).cast("array<struct<path: bigint, prior: int>>"))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [main_text(page, set() if r is None else {(x["path"], x["prior"]) for x in r}) for page, r in zip(pdf["html"], pdf["odd"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": got, "n_chars": [len(t) for t in got]})

    kind = dict(rows.dtypes)["id"]
    out = rows.select("id", "url", "html", "odd").mapInPandas(texts, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLES: dict[str, str] = {}
