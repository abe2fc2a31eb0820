"""Frames with awkward extra columns, brute force, and a run of an oracle."""

from __future__ import annotations

import os
import re
from collections import Counter

import duckdb

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside.
CLASH = ("id", "row", "w", "n", "h", "key", "label", "lead", "bucket", "split", "removed", "host", "rule", "_gone", "_bad_id")


def documents(spark, texts, ids=None, clash=True, text="text"):
    """doc_id, text, lang, source, n_chars and columns whose names clash with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), *(["x"] * len(CLASH) if clash else [])) for i, t in zip(ids, texts, strict=True)]
    kind = f"doc_id long, {text} string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in (CLASH if clash else ()))
    return spark.createDataFrame(rows, kind)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.sql(sql)
    return Counter(tuple(r[found.columns.index(c)] for c in sorted(found.columns)) for r in found.fetchall())


def spark_rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
