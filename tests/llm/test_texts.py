"""Extraction, packing, repeated passages and the pipeline, against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import components, documents, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from vertexloom.llm import decontaminate, html, neardup, packing, shingles as sh, substrings

SF = "/root/testdata/sf0.001"


def test_blocks_of_a_page():
    page = (
        "<html><head><title>T</title></head><body><header>menu</header><nav>n</nav><div class='cookie-notice'>ok?</div><main><header><h1>Head &amp; more</h1></header>"
        "<p>One  <b>two</b>\n three<br>four &lt;p&gt; &#233;<ul><li>a<li>b</ul><div class=comments><p>c</div><form>q</form><script>if (a<b) x()</script><p>last&nbsp;end</main>"
        "<aside>s</aside><footer>f</footer>"
    )
    assert html.main_text(page) == "Head & more\nOne two three four <p> é\na\nb\nlast end"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> \n") == ""
    assert html.main_text("<article><p>cut <b") == "cut" and html.main_text("a < b") == "a < b"
    assert html.main_text("<p>x</p></div></p>y" + "<div>" * 3000 + "z") == "x\ny\nz"


@pytest.mark.parametrize("noise", ["<datalist><option value=a><option value=b></datalist>", "<svg width='1'/>", "<svg><path d='x'/><g><text>t</text></g></svg>", "<svg><circle r=1>", "<option>o", "<select><option>a<option>b</select>", "<button>b</button>", "<object data=x />", "<canvas>c</canvas>"])
def test_noise_elements_end(noise):
    assert html.main_text(f"<body>{noise}<article><p>kept</p></article>{noise}<p>more</p></body>") == "kept\nmore"
    assert html.main_text(f"<div>{noise}</div><p>after</p>") == "after"


def test_text_of_formulas():
    assert html.main_text("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><p>next</p></article>") == "let x=2 be\nnext"
    assert html.main_text("<p>a <math/> b</p><p>c <math><mi>y</p><p>d</p>") == "a b\nc y\nd"


def test_style_tree_removes_what_repeats(spark):
    rows = []
    for i in range(40):
        body = f"<div class=top>Always the same</div><div class=story><p>story {i} alpha{i}</p><p>beta{i * i}</p></div><div class=bottom><span>same end</span></div>"
        rows.append((i, f"http://one.net/{i}", body, "x"))
    rows += [(100, "http://few.net/", "<div>short</div>", "x"), (101, None, None, "x"), (102, "bad", "", "x"), (103, "http://one.net/0", rows[0][2], "x")]
    rows += [(200 + i, "http://copies.net/", "<article><p>the same article</article>", "x") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert got[7]["text"] == "story 7 alpha7\nbeta49" and got[103]["text"] == got[0]["text"]
    assert [got[i]["text"] for i in (100, 101, 102, 210)] == ["short", "", "", "the same article"] and got[100]["n_chars"] == 5
    assert len(got) == len(rows) and html.extract(pages.limit(0)).count() == 0


def test_repeated_text_beside_unique_children(spark):
    mixed = [(i, "http://a.net/", f"<div class=story>Share this<p>unique article {i} x{i * i}</p></div>", "x") for i in range(30)]
    direct = [(100 + i, "http://b.net/", f"<body><a href=#main>Skip to content</a><div class=story>unique text {i} y{i * i}</div></body>", "x") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(mixed + direct, "page_id long, url string, html string, host string")).collect()}
    assert got == {i: f"unique article {i} x{i * i}" for i in range(30)} | {100 + i: f"unique text {i} y{i * i}" for i in range(30)}


def test_class_names_of_noise():
    page = "<article><p class='social-science'>a</p><section class='related-work'><p>b</p></section><div id=ad-hoc>c</div><div class='site-footer'>d</div><p class='ad-slot-1'>e</p><div class='x related-posts'>f</div></article>"
    assert html.main_text(page) == "a\nb\nc"


def test_bad_pages_take_linear_time():
    import time
    import tracemalloc

    for page in ("<a " * 350_000, "<div>" * 100_000 + "x", "<b><div>" * 40_000 + "</b>" * 40_000, "<b>" * 50_000 + "<hr>x" * 50_000, "</p>" * 200_000, '<a "' * 100_000 + ">", "<p><li>" * 50_000, "<svg><div/>" * 50_000, "<!-" * 200_000):
        began = time.process_time()
        html.blocks(page)
        assert time.process_time() - began < 5, page[:20]
    tracemalloc.start()
    layout = {}
    html.blocks("<div class=a>" * 100_000 + "x", layout)
    assert len(layout) == 100_000 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_tree_against_brute_force(spark):
    """The tree of a small table, counted page by page, and what it removes inside of articles."""
    from math import log

    rows = [(i, f"http://a.net/{i}", f"<div class=abc>same links</div><article><p>story {i}</p><div class=bar>Tell your friends</div></article><div class=box>teaser {i}</div>", "x") for i in range(30)]
    rows += [(100 + i, "http://b.net/", f"<div class=ad>ad {i}</div><article><p>one article</p></article>", "x") for i in range(30)]
    rows += [(200 + i, f"http://c.net/{i}", f"<body>same words<div class=story><p>story {i}</p>{'<p>next</p>' * (i % 3)}</div></body>", "x") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page string")
    tree, shapes = {}, {}
    for _, url, page, _ in rows:
        layout = {}
        found = html.blocks(page, layout)
        for around, children in layout.items():
            for child in children:
                shapes.setdefault((url.split("/")[2], child), {}).setdefault(page, tuple(layout[around]))
        for path, prior, _ in found:
            said = "\n".join(t for p, q, t in found if (p, q) == (path, prior))
            whole = "\n".join(t for _, q, t in found if q == prior)
            tree.setdefault((url.split("/")[2], path, prior), {}).setdefault(said, set()).add(whole)

    def entropy(n):
        m = sum(n)
        return round(-sum(x / m * log(x / m) for x in n) / log(m), 9) + 0.0 if m > 1 else 0.5

    want = {}
    for key, said in tree.items():
        n = [len(w) for w in said.values()]
        # pages count once for each layout; none around the body's own texts
        around = shapes.get(key[:2])
        want[key] = (sum(n), entropy(n), around and entropy(list(Counter(around.values()).values())))
    rounded = lambda x: None if x is None else round(x, 9) + 0.0
    got = {(r["host"], r["path"], r["prior"]): (r["pages"], rounded(r["content"]), rounded(r["presentation"])) for r in html.style_tree(html.branches(pages, "url", "html")).collect()}
    assert got == want and len(want) == 7 and {0.0, None} < {p for _, _, p in want.values()}
    texts = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert texts[3] == "story 3\nteaser 3" and texts[103] == "one article" and texts[204] == "story 4\nnext"


def test_layout_weighs_in_the_importance(spark):
    """Texts of equal entropy: what stands in a layout that varies is the more important."""
    rows = [("h", 1, 1, 1000, p, c) for p, c in ((0.0, 0.43), (1.0, 0.43), (None, 0.43), (None, 0.3))]
    tree = spark.createDataFrame(rows, "host string, path long, prior int, pages long, presentation double, content double")
    kept = [r["k"] for r in tree.select((html.importance() >= html.LEAST_IMPORTANCE).alias("k")).collect()]
    assert kept == [False, True, True, False]


def test_pages_of_the_test_data(spark):
    for r in html.op1_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id").collect():
        assert r["n_chars"] == len(r["text"]) and "<" not in r["text"].replace("<p", "") and r["text"]
        assert "track(" not in r["text"] and "©" not in r["text"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=120))
def test_differencing(sizes):
    dealt = packing.pack(sizes)
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in dealt)


def test_differencing_balances():
    sizes = np.random.default_rng(3).integers(1, 400, 600).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 40)]
    assert max(sums) - min(sums) < 40


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["it's ΣΑΣ", "<|endoftext|>x", "e\u0301 a", "İ don't", "\u00a0a\x85b", "12,3###"])), max_size=5))
def test_chunks_encode_like_the_whole(texts):
    path = str(public_tokenizers.path(packing.TOKENIZER))
    whole = Tokenizer.from_file(path)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [i.tolist() for i in packing.tokenizer_of(path).ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(rows, texts_by_id):
    whole = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts_by_id)
    for doc, pieces in by_doc.items():
        ids = np.array(whole.encode(texts_by_id[doc] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_pack_round_trip(spark):
    texts = [None, "", "a", "word " * 30_000, "x y z"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = packing.pack_documents(documents(spark, texts)).collect()
    check_pieces(rows, dict(enumerate(texts)))
    assert packing.pack_documents(documents(spark, [])).count() == 0
    assert packing.pack_documents(documents(spark, ["a b", "a b"], [None, None])).agg({"length": "sum"}).first()[0] == 6


def test_pack_whole_documents(spark):
    """Uncut documents: near-equal windows within the capacity, more of them than the tokens alone would need."""
    texts = [" ".join(["word"] * (1 + 37 * i % 900)) for i in range(200)] + [None, "word " * 5000]
    rows = packing.pack_documents(documents(spark, texts).coalesce(1), whole=True, block=64).collect()
    pieces, filled = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    assert all(len(p) == 1 for d, p in pieces.items() if d != 201) and len(pieces[201]) == 3
    assert sum(filled.values()) == sum(p[0]["doc_tokens"] for p in pieces.values())
    assert max(filled.values()) <= 2048 and sum(filled.values()) / 2048 <= len(filled) <= sum(filled.values()) / 2048 * 1.3 + 2


def test_shingles_of_a_long_text(monkeypatch):
    texts = ["A b  c\u00a0d", None, "", "one", " ".join(f"w{i % 7}" for i in range(500))]
    want = [set(s.tolist()) for s in sh.shingle_sets(texts, 2)]
    monkeypatch.setattr(sh, "PIECE", 50)
    assert [set(s.tolist()) for s in sh.shingle_sets(texts, 2)] == want
    assert [len(s) for s in want] == [len(shingles(t, 2)) for t in texts]
    p = sh.Paragraphs(texts, 5, sh.MinMax(4, 2))
    alone = [list(sh.shingle_sets([t], 5))[0] for t in texts]
    assert p.n.tolist() == [len(s) for s in alone if len(s)]


def brute_passages(texts, least):
    lines = []
    for d, t in texts.items():
        order = 0
        for pos, line in enumerate((t or "").split("\n")):
            if words(line):
                lines.append((d, pos, order, len(words(line)), frozenset(shingles(line, 5))))
                order += 1
    links = [(i, j) for i in range(len(lines)) for j in range(i) if lines[i][4] & lines[j][4] and 100 * len(lines[i][4] & lines[j][4]) >= 80 * len(lines[i][4] | lines[j][4])]
    of = components(range(len(lines)), links)
    first = {}
    for i, line in enumerate(lines):
        first[of[i]] = min(first.get(of[i], line[:2]), line[:2])
    later = defaultdict(list)
    for i, line in enumerate(lines):
        if first[of[i]] != line[:2]:
            later[line[0]].append((line[2], line[1], line[3]))
    out = {}
    for d, found in later.items():
        run, gone = [], []
        for x in [*sorted(found), None]:
            if run and (x is None or x[0] != run[-1][0] + 1):
                gone += [r[1] for r in run] if sum(r[2] for r in run) >= least else []
                run = []
            run.append(x)
        if gone:
            out[d] = sorted(gone)
    return out


def test_passages_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()}
    long = " ".join(f"p{i}" for i in range(60))
    extra = [f"start of one\n{long}\nend", f"other start\n\n{long} more\nother end", f"{long}\n{long}", None, "", "\n \n", "short line\nshort line", "a line of six words here\n" * 9]
    ids = [*texts, *range(10_000, 10_000 + len(extra))]
    docs = documents(spark, [*texts.values(), *extra], ids)
    done = substrings.dedup_passages(docs)
    want = brute_passages(dict(zip(ids, [*texts.values(), *extra], strict=True)), substrings.LEAST_WORDS)
    got = {r["doc_id"]: r for r in done.collect()}
    assert {d: sorted(x["pos"] for x in r["removed"]) for d, r in got.items() if r["removed"]} == want
    assert len(want) >= 3 and got[10_001]["text"] == "other start\n\nother end" and got[10_003]["text"] is None and got[10_004]["text"] == ""
    assert got[10_002]["text"] == "" and got[10_006]["text"] == extra[6]
    assert set(done.columns) == set(docs.columns) and substrings.dedup_passages(documents(spark, [])).count() == 0


def brute_spans(texts, gone, least):
    """By document, the places of the words that an earlier equal window covers."""
    first, covered = {}, defaultdict(set)
    for d in sorted(texts):
        lines = (texts[d] or "").split("\n")
        w, live = words(texts[d]), [pos not in gone.get(d, ()) for pos, line in enumerate(lines) for _ in words(line)]
        for at in range(len(w) - least + 1):
            if any(live[at : at + least]):
                of = first.setdefault(tuple(w[at : at + least]), (d, at))
                if of[0] != d or at >= of[1] + least:
                    covered[d].update(range(at, at + least))
    return covered


def test_spans_inside_lines(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage, ends = prose(60), prose(120).split(" ")
    own = [prose(120) for _ in range(4)]
    extra = [f"{own[0]} {passage} {own[1]}", f"{own[2]}  {passage.upper()} {own[3]}", f"a b {' '.join(ends)} c", f"é {' '.join(ends[:50])}\n{' '.join(ends[50:])}\td \n\nend", None, "", "spam " * 200]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts |= dict(zip(range(10_000, 10_007), extra, strict=True))
    docs = documents(spark, list(texts.values()), list(texts))
    gone = {r["doc_id"]: {x["pos"] for x in r["removed"]} for r in substrings.dedup_passages(docs).collect()}
    got = {r["doc_id"]: r for r in substrings.dedup_repeats(docs).collect()}
    covered = brute_spans(texts, gone, substrings.LEAST_WORDS)
    for d, text in texts.items():
        place, left = 0, []
        for pos, line in enumerate((text or "").split("\n")):
            for w in words(line):
                if pos not in gone[d] and place not in covered[d]:
                    left.append(w)
                place += 1
        assert words(got[d]["text"]) == left, d
        assert sum(x["words"] for x in got[d]["removed"]) == place - len(left)
    assert got[10_001]["text"] == f"{own[2]}  {own[3]}" and got[10_001]["removed"][0]["first_id"] == 10_000
    assert got[10_000]["text"] == extra[0] and got[10_003]["text"] == "é\nd \n\nend" and got[10_004]["text"] is None
    assert words(got[10_006]["text"]) == ["spam"] * 40
    assert substrings.dedup_repeats(documents(spark, [])).count() == 0 and set(substrings.dedup_repeats(docs).columns) == set(docs.columns)


def test_rows_that_share_an_id_keep_unique_text(spark):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9000, n))
    shared, unique, tails = prose(60), prose(60), [prose(30) for _ in range(3)]
    texts = [shared, f"{unique}\n{tails[0]}", f"{shared}\n{tails[1]}", f"{tails[2]} {shared} end", None, f"{unique} x"]
    got = [(r["doc_id"], r["text"]) for r in substrings.dedup_repeats(documents(spark, texts, [1, 7, 7, 7, 7, None])).collect()]
    assert sorted(got, key=str) == sorted([(1, shared), (7, texts[1]), (7, tails[1]), (7, f"{tails[2]} end"), (7, None), (None, texts[5])], key=str)
    twice = substrings.dedup_repeats(documents(spark, [shared, f"{tails[0]}\n{shared}", f"{tails[0]}\n{shared}"], [1, 2, 2])).collect()
    assert sorted(r["text"] for r in twice) == sorted([shared, tails[0], tails[0]])


def test_recall_of_planted_passages(spark):
    """Passages of 60 words on a line of their own, inside of a line, and wrapped otherwise."""
    rng = np.random.default_rng(23)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30_000, n))
    texts, want = [], {}
    for i in range(60):
        passage = " ".join(f"p{i}_{j}" for j in range(60))
        wrapped = lambda n: "\n".join(" ".join(passage.split(" ")[k : k + n]) for k in range(0, 60, n))
        copies = [f"{prose(50)}\n{passage}\n{prose(50)}", f"{prose(50)}\n{passage}\n{prose(20)}", f"{prose(80)} {passage} {prose(80)}", f"{prose(30)}\n{wrapped(13)}\n{prose(30)}", f"{prose(5)} {wrapped(17)} {prose(5)}"]
        want |= {len(texts) + k: set(words(passage)) for k in range(1, 5)}
        texts += copies
    clean = [prose(150) for _ in range(50)]
    got = {r["doc_id"]: r for r in substrings.dedup_repeats(documents(spark, texts + clean)).collect()}
    caught = [not want[d] & set(words(got[d]["text"])) for d in want]
    assert sum(caught) >= 0.9 * len(want)
    assert all(got[len(texts) + i]["text"] == t and not got[len(texts) + i]["removed"] for i, t in enumerate(clean))
    assert all(got[d]["text"] == texts[d] for d in range(0, len(texts), 5))


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    passage, item = prose(60), prose(20)
    good = [prose(80) for _ in range(6)]
    texts = [*good, "too short", None, good[0], good[1] + " tail", prose(70) + "\n" + passage, prose(70) + "\n" + passage, prose(60) + " " + item + " " + prose(10), "spam spam spam " * 40]
    documents(spark, texts, clash=False).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = corpus_pipeline.read(spark, str(tmp_path), "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept == [[0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12], [0, 1, 2, 3, 4, 5, 10, 11, 12], [0, 1, 2, 3, 4, 5, 10, 11, 12], [0, 1, 2, 3, 4, 5, 10, 11]]
    left = {r["doc_id"]: r for r in docs.collect()}
    assert left[11]["text"] == texts[11].split("\n")[0] and left[11]["n_chars"] == len(left[11]["text"]) and left[10]["text"] == texts[10]
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), {d: r["text"] for d, r in left.items()})


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, clashing columns; then no rows at all."""
    rng = np.random.default_rng(31)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    one, two, three, four, item = prose(90), prose(90), prose(90), prose(90), prose(20)
    rows = [(one, 1), (one, 1), (two, 1), (three, None), (three, None), (one, 2), (four, None), (None, 3), ("", 4), (f"{prose(60)} {item}", 5), (prose(60), 5)]
    clean = rows[-1][0]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("some", rows), ("none", [])):
        docs = documents(spark, [t for t, _ in some], [i for _, i in some])
        want = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            assert docs.columns == want
        texts = sorted(r["text"] for r in docs.collect())
        assert texts == (sorted([one, two, three, four, clean]) if some else [])
        assert (corpus_pipeline.pack(spark, docs, str(tmp_path)).count() > 0) == bool(some)


def test_import_errors_are_not_swallowed():
    for module in (corpus_pipeline, decontaminate, neardup):
        assert "ImportError" not in open(module.__file__).read()


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    import __spark_entry__ as entry

    assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1 and "pipeline" in entry.queries()
