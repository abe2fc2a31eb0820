"""Repeated spans of words, wherever they begin and end in a line or across lines.

Every window of ``least`` words has a fingerprint: the least hash of the shorter windows in it
(winnowing), so two texts that share such a window share a fingerprint. Around fingerprints
that occur twice, every window of ``least`` words is named by a hash of 64 bits; those with an
earlier equal, by document and place, are covered, and the words that are covered go. Each of them stands
in an earlier window, so of every span one copy stays. A window of a document repeats one of
the same document only when the two don't overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _lines, _power, encoded, mix
from .tables import Scratch, give_back

#: Texts that are hashed at once.
TEXTS = 64
#: Words of the shorter windows; the more of them in a window, the fewer fingerprints.
SHORT = 10
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding(of, x: np.ndarray, n: int) -> np.ndarray:
    """``of`` (minimum or maximum) over every n neighbours of ``x``."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = of(x[:-step], x[step:]) if len(x) > step else x[:0]
        size += step
    return x


class Windows:
    """The words of many texts in a row: ``text`` and ``at`` say where each stands.

    ``live`` marks the starts of windows of ``least`` words in one text that aren't gone
    altogether, ``gone`` being the lines of each text that have been removed.
    """

    def __init__(self, texts: list[str | None], gone: list, least: int):
        hashes, at, text, out = [], [], [], []
        for i, (h, line) in enumerate(_lines([encoded(t) for t in texts])):
            hashes.append(h)
            at.append(np.arange(len(h)))
            text.append(np.full(len(h), i))
            out.append(np.isin(line, np.asarray(gone[i])) if gone[i] is not None and len(gone[i]) else np.zeros(len(h), dtype=bool))
        empty = np.zeros(0, dtype=np.int64)
        join = lambda x: np.concatenate(x) if x else empty
        h, self.at, self.text, self.least, self.short = join(hashes).astype(np.uint64), join(at), join(text), least, min(SHORT, (least + 1) // 2)
        self.sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * _power(len(h) + 1)[0][: len(h)], out=self.sums[1:])
        n = max(0, len(h) - least + 1)
        left = np.concatenate(([0], np.cumsum(~join(out).astype(bool))))
        self.live = (self.text[:n] == self.text[len(h) - n :]) & (left[len(left) - n :] > left[:n])

    def hashed(self, size: int) -> np.ndarray:
        """A hash of every ``size`` words in a row."""
        n = max(0, len(self.at) - size + 1)
        return mix((self.sums[size : size + n] - self.sums[:n]) * _power(len(self.at) + 1)[1][:n])

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the shorter windows that are the least of a live window."""
        h, inside = self.hashed(self.short) | np.uint64(1), self.least - self.short + 1
        least = np.where(self.live, _sliding(np.minimum, h, inside), np.uint64(0))
        edge = np.zeros(inside - 1, dtype=np.uint64)
        of = np.flatnonzero(h == _sliding(np.maximum, np.concatenate((edge, least, edge)), inside)) if len(least) else np.zeros(0, dtype=np.int64)
        return of, h[of]

    def near(self, places: np.ndarray) -> np.ndarray:
        """The live windows that hold one of the shorter windows at ``places``."""
        inside, n = self.least - self.short + 1, len(self.live)
        marks = np.zeros(n + inside, dtype=np.int64)
        marks[places + 1] = 1
        marks = np.cumsum(marks)
        return np.flatnonzero(self.live & (marks[inside : inside + n] > marks[:n]))


def cut(text: str, gone: list[int], found: list[tuple[int, object]], least: int) -> tuple[list, list, list]:
    """Take the windows ``found`` (place, first_id) from a text whose lines ``gone`` went before.

    Gives the pieces removed (pos, words, first_id), one for each line of a span, the lines that
    go whole, and of all other lines that lose words the pieces (pos, start, length) that stay.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    why: list = [None] * len(words)
    upto = 0
    for at, first in sorted(found, key=lambda f: f[0]):
        for k in range(max(at, upto), at + least):
            why[k] = (first,)
        upto = max(upto, at + least)
    removed, whole, parts, k, begin, old = [], [], [], 0, 0, set(gone)
    for pos, line in enumerate(text.split("\n")):
        a, end = k, begin + len(line)
        while k < len(words) and words[k][0] < end:
            k += 1
        hit = [i for i in range(a, k) if why[i]]
        if hit and pos not in old:
            before = None
            for i in hit:
                if before != i - 1:
                    removed.append([pos, 0, why[i][0]])
                removed[-1][1] += 1
                before = i
            if len(hit) == k - a:
                whole.append(pos)
            else:
                # a piece goes up to the next word that stays, or with the white space before it at a line's end
                start, i = begin, a
                while i < k:
                    if not why[i]:
                        i += 1
                        continue
                    j = i
                    while j < k and why[j]:
                        j += 1
                    stop = words[i][0] if j < k or i == a else words[i - 1][1]
                    if stop > start:
                        parts.append((pos, start - begin, stop - start))
                    start, i = words[j][0] if j < k else end, j
                if end > start:
                    parts.append((pos, start - begin, end - start))
        begin = end + 1
    return [tuple(r) for r in removed], whole, parts


def shortened(text: str, gone: list[tuple], found: list[tuple], least: int) -> tuple[str, list[tuple]]:
    """A text without the lines ``gone`` (pos, words, first_id) and the windows ``found``, and all that it lost."""
    pieces, whole, parts = cut(text, [g[0] for g in gone], found, least) if found else ([], [], [])
    out, kept = {g[0] for g in gone} | set(whole), {}
    for pos, start, length in parts:
        kept.setdefault(pos, []).append((start, length))
    lines = []
    for pos, line in enumerate(text.split("\n")):
        if pos not in out:
            lines.append("".join(line[a : a + n] for a, n in kept[pos]) if pos in kept else line)
    return "\n".join(lines), [*gone, *pieces]


def repeated_spans(rows: DataFrame, gone: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(id, name, found) of texts with repeated windows: (at, first_id) of each one.

    ``rows`` has (id, name, text) without nulls, ``name`` being a hash of the text; ``gone`` has
    (id, name, gone), the lines of texts that have been removed before. Windows that lie in such
    lines altogether neither go nor count as an earlier copy.
    """
    kind = dict(rows.dtypes)["id"]

    def table(pdf: pd.DataFrame, of: np.ndarray, w: Windows, hashes: np.ndarray) -> pd.DataFrame:
        text = w.text[of]
        return pd.DataFrame({"h": hashes.view(np.int64), "id": pdf["id"].to_numpy()[text], "name": pdf["name"].to_numpy()[text], "at": w.at[of].astype(np.int32)})

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), TEXTS):
                part = pdf.iloc[a : a + TEXTS]
                w = Windows(part["text"].tolist(), [None] * len(part), least)
                of, h = w.fingerprints()
                yield table(part, of, w, h)
        give_back()

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), TEXTS):
                part = pdf.iloc[a : a + TEXTS]
                w = Windows(part["text"].tolist(), part["gone"].tolist(), least)
                base = np.searchsorted(w.text, np.arange(len(part)))
                of = w.near(np.concatenate([np.asarray(p, dtype=np.int64) + b for p, b in zip(part["places"], base, strict=True)]))
                yield table(part, of, w, w.hashed(least)[of])
        give_back()

    columns = f"h long, id {kind}, name long, at int"
    prints = scratch.save(rows.mapInPandas(fingerprints, columns))
    again = scratch.save(prints.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    again = prints.join(again.hint("shuffle_hash"), "h", "left_semi")
    places = again.groupBy("id", "name").agg(F.collect_set("at").alias("places")).join(gone, ["id", "name"], "left")
    every = scratch.save(rows.join(places.hint("shuffle_hash"), ["id", "name"]).mapInPandas(windows, columns))
    scratch.drop(prints)
    # most windows stand once: a count, which needs no sort, leaves few for the first place
    twice = scratch.save(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    twice = scratch.save(every.join(twice.hint("shuffle_hash"), "h", "left_semi"))
    scratch.drop(every)
    first = scratch.save(twice.groupBy("h").agg(F.min(F.struct("id", "name", "at")).alias("first")))
    later = twice.join(first.hint("shuffle_hash"), "h")
    later = later.where((F.col("id") != F.col("first.id")) | (F.col("name") != F.col("first.name")) | (F.col("at") >= F.col("first.at") + least))
    found = scratch.save(later.groupBy("id", "name").agg(F.collect_set(F.struct("at", F.col("first.id").alias("first_id"))).alias("found")))
    scratch.drop(twice, first)
    return found
