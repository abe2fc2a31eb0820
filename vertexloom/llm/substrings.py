"""Repeated passages: paragraph MinHash banding, exact Jaccard, removal by components.

A paragraph is a line of a text. Paragraphs with equal sets of five-word shingles are alike at
once; others meet in the buckets of a banding tuned for recall (two values a band, ten bands:
of a similarity of 0.8, four in 100,000 pairs meet nowhere) and are linked when their exact
Jaccard similarity is at least 0.8. Of each component the first paragraph, by document and
place, stays. Short lines alone are no passage: what goes are runs of repeated paragraphs, one
after the other in a document, of at least ``LEAST_WORDS`` words together.

``dedup_passages`` removes such lines; ``dedup_repeats`` also cuts spans of as many words that
repeat inside of lines, or begin and end within them (``spans``).

A document is named by its id and a hash of its text, ``name``: rows of one id with different
texts are documents of their own, in the order of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .neardup import confirmed_links, led_by_size, sets_of
from .shingles import MinMax, Paragraphs
from .spans import repeated_spans, shortened
from .tables import Scratch, free_name, give_back, read

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 10, 2
LEAST_WORDS = 40
#: Unequal sets of fewer shingles can't reach the similarity: 3 / 4 < 0.8.
LEAST_SET = 4
#: Texts that are turned into paragraphs at once.
TEXTS = 64


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, text) of the documents that can lose something."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("name"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, name, pos, ord, words, n, k1, k2, bands) of every line with a word of (id, name, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = MinMax(BANDS, ROWS)
        for pdf in batches:
            for a in range(0, len(pdf), TEXTS):
                part = pdf.iloc[a : a + TEXTS]
                p = Paragraphs(part["text"].tolist(), SHINGLE, hashing)
                banded = [b if n >= LEAST_SET else None for b, n in zip(p.bands, p.n.tolist(), strict=True)]
                yield pd.DataFrame({"id": part["id"].to_numpy()[p.text], "name": part["name"].to_numpy()[p.text], "pos": p.pos, "ord": p.order, "words": p.words, "n": p.n, "k1": p.k1, "k2": p.k2, "bands": banded})
        give_back()

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, name long, pos int, ord int, words int, n int, k1 long, k2 long, bands array<long>")


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _shown(rows: DataFrame, lines: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text) of one line for each of the sets ``wanted`` (k1)."""
    right = scratch.small(wanted)
    few = right is not wanted
    # a shuffled join comes after the sets are made distinct, so that no frequent line meets in a task
    shown = (lines.join(right, "k1", "left_semi") if few else lines).groupBy("k1", "k2").agg(F.min(F.struct("id", "name", "pos")).alias("at"))
    shown = shown if few else shown.join(right, "k1", "left_semi")
    shown = shown.groupBy(F.col("at.id").alias("id"), F.col("at.name").alias("name")).agg(F.collect_list(F.struct("k1", F.col("at.pos").alias("pos"))).alias("shown"))
    both = rows.join(shown.hint("shuffle_hash"), ["id", "name"])
    of_text = _once(F.split("text", "\n"), lambda parts: F.transform("shown", lambda s: F.struct(s["k1"].alias("id"), F.get(parts, s["pos"]).alias("text"))))
    return both.select(F.inline(of_text)).distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, name, removed) of the documents that lose paragraphs: (pos, words, first_id) of each one."""
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    lines = scratch.save(paragraphs(rows))

    # near copies: k1 stands for a set here; a clash of k1 only adds pairs to compare
    banded = lines.where("bands IS NOT NULL").select(F.col("k1").alias("id"), "n", F.explode("bands").alias("bucket"))
    buckets = scratch.save(banded.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket"))
    members = scratch.save(banded.join(scratch.small(buckets, "shuffle_hash"), "bucket").select("bucket", "id", "n").distinct())
    members = scratch.save(led_by_size(members, PERCENT))
    sets = scratch.save(sets_of(_shown(rows, lines, scratch.save(members.select(F.col("id").alias("k1")).distinct()), scratch), SHINGLE))
    labels = connected_components(confirmed_links(members, sets, PERCENT, scratch), scratch)
    scratch.drop(members, sets)

    # a component of near copies, or else a set of its own, named in full
    known = labels.select(F.col("node").alias("k1"), F.col("component").alias("c1"))
    own = scratch.save(lines.join(scratch.small(scratch.save(known), "shuffle_hash"), "k1", "left").select(
        "id", "name", "pos", "ord", "words", F.coalesce("c1", "k1").alias("c1"), F.when(F.col("c1").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("c2")))
    scratch.drop(lines)
    firsts = own.groupBy("c1", "c2").agg(F.min(F.struct("id", "name", "pos")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("c1", "c2", "first")
    firsts = scratch.save(firsts)
    later = own.join(scratch.small(firsts, "shuffle_hash"), ["c1", "c2"]).where(F.struct("id", "name", "pos") != F.col("first"))
    per_doc = later.groupBy("id", "name").agg(F.sort_array(F.collect_set(F.struct("ord", "pos", "words", F.col("first.id").alias("first_id")))).alias("later"))
    kind = dict(rows.dtypes)["id"]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, name, later in zip(pdf["id"], pdf["name"], pdf["later"], strict=True):
                gone, run = [], []
                for line in [*later, None]:
                    if run and (line is None or line["ord"] != run[-1]["ord"] + 1):
                        if sum(r["words"] for r in run) >= least_words:
                            gone += run
                        run = []
                    run.append(line)
                if gone:
                    out.append((doc, name, [{"pos": r["pos"], "words": r["words"], "first_id": r["first_id"]} for r in gone]))
            yield pd.DataFrame(out, columns=["id", "name", "removed"])

    out = scratch.save(per_doc.mapInPandas(runs, f"id {kind}, name long, removed array<struct<pos: int, words: int, first_id: {kind}>>"))
    scratch.drop(own, firsts)
    return out


def _without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, least_words: int, removed_col: str) -> DataFrame:
    """``docs`` without the lines and windows that ``lost`` (id, name, lines, found) names, and ``removed_col``."""
    docs = docs.drop(removed_col)
    gid, gname, gone = (free_name(docs, x) for x in ("_gone_id", "_gone_name", "_gone"))
    kinds = dict(lost.dtypes)

    def shorten(texts: pd.Series, lines: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone, windows in zip(texts, lines, found, strict=True):
            if text is None:
                out.append((None, None))
                continue
            gone = [] if gone is None else [(g["pos"], g["words"], g["first_id"]) for g in gone]
            left, removed = shortened(text, gone, [] if windows is None else [(f["at"], f["first_id"]) for f in windows], least_words)
            out.append((left, [dict(zip(("pos", "words", "first_id"), r, strict=True)) for r in removed]))
        return pd.DataFrame(out, columns=["text", "removed"])

    shorter = F.pandas_udf(shorten, f"text string, removed {kinds['lines']}")
    right = lost.select(F.col("id").alias(gid), F.col("name").alias(gname), F.struct("lines", "found").alias(gone)).hint("shuffle_hash")
    both = docs.join(right, (F.col(id_col) == F.col(gid)) & (F.xxhash64(text_col) == F.col(gname)), "left")
    # texts that lose nothing don't go to Python
    both = both.withColumn(gone, shorter(F.when(F.col(gid).isNotNull(), F.col(text_col)), F.col(f"{gone}.lines"), F.col(f"{gone}.found")))
    text = F.when(F.col(gid).isNull(), F.col(text_col)).otherwise(F.col(f"{gone}.text"))
    removed = F.coalesce(F.col(f"{gone}.removed"), F.array().cast(kinds["lines"]))
    return both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], removed.alias(removed_col))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, removed_col: str = "removed") -> DataFrame:
    """Every row of ``docs`` with column ``removed_col`` added and repeated passages taken from its text.

    Rows alike in id and text are one document and lose the same; rows of one id with different
    texts are each their own. Null ids, null texts and texts without words are left as they are,
    with an empty ``removed``. Passages of fewer than ``least_words`` words stay. Texts of any
    length are read whole. A text may become empty; its row stays. An empty table gives an empty
    table. A column of ``docs`` named ``removed_col`` is replaced; others may have any name.
    """
    gone = repeated_passages(docs, id_col, text_col, least_words)
    kind = dict(gone.dtypes)["id"]
    lost = gone.select("id", "name", F.col("removed").alias("lines"), F.lit(None).cast(f"array<struct<at: int, first_id: {kind}>>").alias("found"))
    return _without(docs, lost, id_col, text_col, least_words, removed_col)


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, removed_col: str = "removed") -> DataFrame:
    """As ``dedup_passages``, and repeated spans that aren't whole lines go too.

    ``removed`` then has an entry for each line of such a span as well, with the words that the
    line loses; a line that loses all goes whole.
    """
    scratch = Scratch(docs.sparkSession)
    gone = repeated_passages(docs, id_col, text_col, least_words)
    found = repeated_spans(_rows(docs, id_col, text_col), gone.select("id", "name", F.col("removed.pos").alias("gone")), least_words, scratch)
    lost = gone.select("id", "name", F.col("removed").alias("lines")).join(found, ["id", "name"], "full")
    return _without(docs, scratch.save(lost), id_col, text_col, least_words, removed_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_repeats(read(spark, sf_dir, "documents"))
    words = F.aggregate("removed", F.lit(0), lambda n, r: n + r["words"]).cast("long")
    return done.select("doc_id", F.size("removed").cast("long").alias("n_removed"), words.alias("removed_words"),
                       F.array_sort(F.array_distinct("removed.first_id")).alias("first_ids"), F.col("removed.pos").alias("removed_lines"), "text")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
