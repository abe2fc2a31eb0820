"""URL filters: allow and block rules, then a list of blocked URLs behind a Bloom filter.

Main path: DataFrame functions only. Every URL's canonical form and its hosts' root URLs are
probed against a blocked Bloom filter of the listed canonical URLs; possible hits, usually few,
go to an exact join that removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .tables import Scratch, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest one wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The setting that names a list of blocked URLs for the query: a text file or folder, or a Parquet table with a column ``url``.
LIST_SETTING = "vertexloom.url.list"
#: The list where that is unset. The root URL of a host stands for the whole site and its subdomains.
LISTED = (
    "http://cheap-pills.example.com/",
    "http://casino-win.example.org/",
    "http://spam-farm.example.org/",
    "http://adult-x.example.net/",
    "http://ads-track.example.org/",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a default port, path (at least ``/``) and query; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    path = path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query)


def site_keys(url: Column) -> Column:
    """The canonical URL, and the root URL of its host and of each parent domain."""
    name = F.regexp_replace(host_of(url), r":[0-9]*$", "")
    parts = F.split(name, r"\.")
    roots = F.transform(parts, lambda _, i: F.concat(F.array_join(F.slice(parts, i + 1, F.size(parts)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(canonical(url)), roots))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. The rules are a bounded parameter."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(rule_host + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Listed URLs, one a row: of a Parquet table, or of text lines without blanks and ``#`` comments."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("url")
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where("url <> '' AND NOT startswith(url, '#')")


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every row of ``pages``: id, host, path, rule, verdict, in_list.

    ``listed`` has a column ``url``. Null URLs and URLs without ``://`` have an empty host and
    path, match nothing and are allowed. Of two rules of one length that fit, the later by name
    wins. URLs of any length are read whole; repeated rows each get a row; an empty table gives
    an empty table. Other columns of either frame are not read, so their names cannot clash. An
    empty list blocks nothing.
    """
    scratch = Scratch(pages.sparkSession)
    keys = scratch.save(listed.where(F.contains("url", F.lit("://"))).select(canonical(F.col("url")).alias("key")).distinct())
    n = keys.count()
    words, blocks = bloom.build(keys.select(F.xxhash64("key").alias("h")), n)
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.coalesce(canonical(url), F.lit("")).alias("canon"),
        F.when(F.contains(url, F.lit("://")), site_keys(url)).alias("keys"),
    )
    judged = rows.select("*", rule.alias("rule"), said.alias("said"))
    possible = judged.where("said IS NULL").select("id", "canon", F.explode("keys").alias("key"))
    possible = possible.where(bloom.might_hold(words.scalar(), F.xxhash64("key"), blocks))
    hits = possible.join(scratch.small(keys), "key", "left_semi").select(F.col("id").alias("hit_id"), F.col("canon").alias("hit_canon")).distinct()
    hits = scratch.small(scratch.save(hits), "shuffle_hash")
    return judged.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("canon") == F.col("hit_canon")), "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("said", F.when(F.col("hit_canon").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        (F.col("hit_canon").isNotNull()).alias("in_list"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(LIST_SETTING, None)
    listed = read_list(spark, path) if path else spark.createDataFrame([(u,) for u in LISTED], "url string")
    return judge_urls(read(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".format(*[x])
        for said, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])) for x in [f"{h}{p}|{said}"]
    )
    names = [u.split("//")[1].strip("/") for u in LISTED]
    listed = " OR ".join(f"name = '{x}' OR ends_with(name, '.{x}')" for x in names)
    return f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name, CASE {fits} END AS hit FROM p)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule,
       coalesce(split_part(hit, '|', 2), CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict
FROM r"""


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLES = {"op5_url_filters": _sql()}
