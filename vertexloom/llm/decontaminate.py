"""Benchmark decontamination by winnowing, in SQL functions only.

A window is eight consecutive words of a benchmark item. Every eight-word span holds five
4-grams; keeping the least 4-gram hash of each five consecutive ones (winnowing) means that any
shared eight-word span has the same fingerprint in the document and in the item. Document
positions whose fingerprint passes a Bloom filter of the benchmark's fingerprints, usually few,
are extended to their eight words and joined with the benchmark's windows exactly, so hash
collisions and filter misses cost work, never rows. An item of fewer than eight words is one
window of its own length and is its own fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .tables import Scratch, free_name, read
from .urls import LOWER, UPPER

SPAN, GRAM = 8, 4
#: So many distinct windows are broadcast to the exact join; more are shuffled.
BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    """A-Z lower-cased runs of ASCII letters, digits and characters beyond ASCII; none for null."""
    parts = F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column, k: int) -> Column:
    return F.transform(_starts(F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def fingerprints(w: Column, span: int, gram: int) -> Column:
    """For every window start, the least ``gram``-gram hash within ``span`` words."""
    width = span - gram + 1
    if width == 1:
        return gram_hashes(w, gram)
    return _once(gram_hashes(w, gram), lambda h: F.transform(
        _starts(F.size(h) - (width - 1)), lambda i: F.least(*[F.get(h, i + j) for j in range(width)])))


def _gram_of(span: int) -> int:
    return GRAM if span == SPAN else span


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """Distinct windows: text ``win``, length ``len``, fingerprint ``fp`` and the items that hold it."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    size = F.size("w")
    starts = _starts(F.greatest(size - (span - 1), F.lit(1)))
    rows = w.select("item", F.least(size, F.lit(span)).alias("len"), F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, span))).alias("words"))
    rows = rows.select("item", "len", F.array_join("words", " ").alias("win"), "words")
    fp = F.xxhash64("words")
    for n in range(1, span + 1):
        fp = F.when(F.col("len") == n, F.get(fingerprints(F.col("words"), n, _gram_of(n)), F.lit(0))).otherwise(fp)
    return rows.groupBy("win", "len").agg(F.min(fp).alias("fp"), F.array_sort(F.collect_set("item")).alias("items"))


def candidates(w: Column, lengths: list[int], words_of_filter: Column, blocks: int) -> Column:
    """(start, len, win) of every window whose fingerprint may be one of the benchmark's."""

    def of(w: Column, n: int, bits: Column) -> Column:
        def pick(f: Column) -> Column:
            at = F.filter(_starts(F.size(f)), lambda i: bloom.might_hold(bits, F.get(f, i), blocks))
            return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("win")))

        return _once(fingerprints(w, n, _gram_of(n)), pick)

    return _once(F.struct(w.alias("w"), words_of_filter.alias("bits")), lambda x: F.concat(*[of(x["w"], n, x["bits"]) for n in lengths]))


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", least_items: int = 2) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_hit, n_items, items (sorted), contaminated.

    Documents without words (null, empty, only punctuation) have no hits; a document is never
    hit by an item without words. Repeated rows are each judged. Items with a null id are left
    out; rows of one item id are one item. An empty benchmark contaminates nothing. Only the
    named columns are read, so other columns may have any name.
    """
    return _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, least_items).select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items", "contaminated")


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, least_items: int) -> DataFrame:
    """``judge`` with ``name``, a hash of the row's text, and its own name for the id."""
    wins = benchmark_windows(benchmark, item_col, item_text_col)
    sizes = wins.groupBy("len").count().collect()  # at most SPAN rows
    lengths, n = sorted(r["len"] for r in sizes), sum(r["count"] for r in sizes)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text_col).alias("name"), words(F.col(text_col)).alias("w"))
    if not lengths:
        lengths, n = [SPAN], 0
    bits, blocks = bloom.build(wins.select(F.col("fp").alias("h")), n)
    rows = rows.withColumn("bits", bits.scalar())
    found = rows.select("id", "row", "name", F.size("w").cast("long").alias("n_words"), candidates(F.col("w"), lengths, F.col("bits"), blocks).alias("c"))
    each = found.select("id", "row", "name", "n_words", F.explode_outer("c").alias("c")).select(
        "id", "row", "name", "n_words", "c.start", F.coalesce("c.len", F.lit(-1)).alias("len"),
        F.coalesce("c.win", F.col("row").cast("string")).alias("win"))  # no row is left without a key: they would all meet in one task
    right = wins.select("win", "len", "items")
    hit = each.join(F.broadcast(right) if n <= BROADCAST_WINDOWS else right, ["win", "len"], "left")
    span = F.when(F.col("items").isNotNull(), F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    docs_hit = hit.groupBy("row", "id", "name", "n_words").agg(F.collect_list(span).alias("spans"), F.collect_set("items").alias("sets"))
    items = F.array_sort(F.array_distinct(F.flatten("sets")))
    return docs_hit.select(
        "id", "name", "n_words", F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.size(items) >= least_items).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 1) -> DataFrame:
    """The rows that hold windows of fewer than ``least_items`` items, all columns kept.

    A row goes with its own text only: of rows that share an id, or have none, those whose texts
    hold no window stay. Columns may have any name.
    """
    scratch = Scratch(docs.sparkSession)
    bad_id, bad_name = free_name(docs, "_bad_id"), free_name(docs, "_bad_name")
    bad = _judged(docs, benchmark, id_col, text_col, "item_id", "text", least_items).where("contaminated").select(F.col("id").alias(bad_id), F.col("name").alias(bad_name))
    bad = scratch.save(bad.distinct())
    return docs.join(scratch.small(bad), F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_col) == F.col(bad_name)), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0 AND item IS NOT NULL)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)"""

QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": SQL}
