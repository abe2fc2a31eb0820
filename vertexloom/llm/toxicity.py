"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: densities of a seed lexicon and of one learned from labelled texts,
how closely their words stand together and to second-person words, capitals, punctuation and
obfuscation rates. Trees and calibration are fitted here in numpy on a bounded sample of
labelled rows, of which a quarter is kept for the calibration. Labels are never features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, read

#: Labelled rows of each class that are fitted on, at most about.
PER_CLASS = 2500
#: A learned term stands in so many toxic texts at least and is so many times likelier there.
LEAST_TEXTS, LEAST_ODDS, TERMS = 6, 12.0, 2000
STEMS = (4, 5, 6, 7)
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Words a worker remembers.
CACHE = 300_000

SEED = frozenset(
    "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown fool imbecile cretin vermin garbage jerk bastard bitch "
    "crap damn shit fuck asshole whore slut freak creep coward liar pig rat filth filthy hate kill die ugly dumbass retard degenerate "
    "dumm idiotisch arschloch scheisse blödmann trottel abschaum wertlos müll versager stupide idiote connard salope merde ordure raté "
    "minable nul crétin estúpido idiota basura mierda imbécil inútil asqueroso payaso perdedor escoria".split()
)
SECOND = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer usted ustedes tú ti tus vosotros os".split())
_LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"(.)\1{2,}")

NAMES = ("log_words", "seed_density", "learned_density", "hits", "distinct_hits", "closest_hits", "near_second", "second_density", "capitals",
         "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "repeated_letters", "digits")


def plain(word: str) -> str:
    return _EDGE.sub("", word)


def deobfuscated(word: str) -> str:
    """Look-alike characters read as letters, inner punctuation and long repeats removed."""
    return _REPEAT.sub(r"\1", _INNER.sub("", word.translate(_LEET)))


def terms(text: str) -> set[str]:
    """A text's distinct words and, marked by ``~``, their stems of four to seven letters."""
    words = {plain(w) for w in text.lower().split()}
    words.discard("")
    return words | {w[:n] + "~" for w in words for n in STEMS if len(w) > n}


class Features:
    """The dense features of texts; what is known of a word is kept for a task."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon, self.known = lexicon, {}

    def _kind(self, word: str) -> int:
        """1: in the seed lexicon, 2: learned, 4: second person, 8: a hit only when deobfuscated."""
        w = plain(word)
        learned = w in self.lexicon or any(w[:n] + "~" in self.lexicon for n in STEMS if len(w) > n)
        kind = (w in SEED) + 2 * learned + 4 * (w in SECOND)
        if not kind & 3 and w and not w.isalpha():
            d = deobfuscated(word)
            kind |= 8 * (d != w and (d in SEED or d in self.lexicon))
        return kind

    def of(self, text: str | None) -> list[float]:
        text = text if isinstance(text, str) else ""
        words = text.lower().split()
        known = self.known
        kinds = []
        for w in words:
            k = known.get(w)
            if k is None:
                k = self._kind(w)
                if len(known) < CACHE:
                    known[w] = k
            kinds.append(k)
        k = np.array(kinds, dtype=np.int64)
        n = max(1, len(words))
        at, you = np.flatnonzero(k & 11), np.flatnonzero(k & 4)
        near = 0
        if len(at) and len(you):
            i = np.searchsorted(you, at)
            left, right = np.abs(at - you[np.maximum(i - 1, 0)]), np.abs(you[np.minimum(i, len(you) - 1)] - at)
            near = int((np.minimum(left, right) <= 5).sum())
        closest = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max()) if len(at) else 0
        count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        upper, letters, chars = int(count[65:91].sum()), int(count[65:91].sum() + count[97:123].sum()), max(1, len(text))
        shout = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
        punctuation = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
        distinct = len({words[i] for i in at})
        return [
            math.log1p(len(words)), float((k & 1).sum()) / n, float((k & 2 > 0).sum()) / n, float(len(at)), float(distinct), float(closest), near / n, len(you) / n,
            upper / max(1, letters), shout / n, count[33] / chars, count[63] / chars, punctuation / chars, float((k & 8 > 0).sum()) / n,
            sum(1 for _ in _REPEAT.finditer(text)) / n, int(count[48:58].sum()) / chars,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))


@dataclass
class Model:
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each: feature, bin and value by heap place
    base: float
    margins: np.ndarray
    levels: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), self.margins, self.levels), 0, 1)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
    """Trees of a fixed depth on the gradients of the weighted logistic loss, split by histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    bins, f = binned(x, edges), x.shape[1]
    rate = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
    base = math.log(rate / (1 - rate))
    margin, trees, places = np.full(len(y), base), [], 2 ** (DEPTH + 1) - 1
    flat = bins + np.arange(f) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        feature, cut, value = np.zeros(places, dtype=np.int64), np.full(places, BINS), np.zeros(places)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                i = np.flatnonzero(node == k)
                if len(i) < 20:
                    continue
                at = flat[i].ravel()
                gs = np.bincount(at, np.repeat(g[i], f), f * BINS).reshape(f, BINS).cumsum(1)
                hs = np.bincount(at, np.repeat(h[i], f), f * BINS).reshape(f, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[k], cut[k] = divmod(best, BINS)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        gs, hs = np.bincount(node, g, places), np.bincount(node, h, places)
        value = np.where(hs > 0, -RATE * gs / (hs + 1), 0.0)
        margin += value[node]
        trees.append((feature, cut, value))
    return Model(edges, trees, base, np.zeros(0), np.zeros(0))


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising levels at the mean margins of their blocks."""
    blocks: list[list[float]] = []
    for i in np.argsort(margin, kind="stable"):
        blocks.append([w[i] * y[i], w[i], w[i] * margin[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def labelled(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str, text_col: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(id, text, toxic) of about ``per_class`` ids of each class, and each class's row weight.

    At most 2.5 times ``per_class`` ids are taken, of one that repeats the least text.
    """
    truth = labels.where(F.col("toxic").isNotNull() & trainable & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in truth.groupBy("toxic").count().collect()}  # two rows
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    part = F.when(F.col("toxic") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    chosen = truth.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < part * (1 << 20)).limit(int(2.5 * per_class) + 100)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(trainable & F.col("text").isNotNull())
    # one row for an id, so that the bound holds however often ids repeat
    rows = rows.join(F.broadcast(chosen), id_col).groupBy(F.col(id_col).alias("id"), "toxic").agg(F.min("text").alias("text"))
    return rows.select("id", "text", "toxic"), {k: 1 / s for k, s in share.items() if s}


def learn_lexicon(rows: DataFrame) -> frozenset[str]:
    """Terms far likelier in toxic texts; counted on the executors, a bounded list comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                for t in terms(text):
                    tally.setdefault(t, [0, 0])[toxic] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in tally.items()], columns=["term", "clean", "toxic"])

    by = rows.mapInPandas(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    odds = (F.col("toxic") + 0.5) / (n.get(1, 0) + 1) / ((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    best = by.where(F.col("toxic") >= LEAST_TEXTS).where(odds >= LEAST_ODDS).orderBy(F.desc("toxic"), "term").limit(TERMS)
    return frozenset(r[0] for r in best.select("term").collect())


def fit(rows: DataFrame, weights: dict[int, float]) -> tuple[Model | None, frozenset[str]]:
    """Lexicon and trees from three quarters of the rows, calibration from the last quarter."""
    learning = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) > 0
    lexicon = learn_lexicon(rows.where(learning))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "x": list(of.matrix(pdf["text"].tolist())), "toxic": pdf["toxic"], "learning": pdf["learning"]})

    flat = rows.select("id", "text", "toxic", learning.alias("learning"))
    got = flat.mapInPandas(features, f"id {dict(flat.dtypes)['id']}, x array<double>, toxic int, learning boolean").sort("id", "x").collect()
    if len({r["toxic"] for r in got if r["learning"]}) < 2 or len({r["toxic"] for r in got if not r["learning"]}) < 2:
        return None, lexicon
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    w, a = np.where(y == 1, weights[1], weights[0]), np.array([r["learning"] for r in got])
    w = w / w.mean()
    model = boost(x[a], y[a], w[a])
    model.margins, model.levels = isotonic(model.margin(x[~a]), y[~a], w[~a])
    return model, lexicon


def score(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 from 0.5 on).

    Null texts are scored like empty ones, equal texts alike; texts of any length are read
    whole. A document with several labels is toxic if one says so; null labels are left out.
    Where a class has no labelled row, every score is 0. Repeated rows each get a row; an empty
    table gives an empty table. Only the named columns and ``toxic`` are read.
    """
    scratch = Scratch(docs.sparkSession)
    rows, weights = labelled(docs, labels, trainable, id_col, text_col, per_class)
    model, lexicon = None, frozenset()
    if len(weights) == 2:
        rows = scratch.save(rows)  # what is learned from is read three times
        model, lexicon = fit(rows, weights)
        scratch.drop(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features(lexicon)
        for pdf in batches:
            s = model.score(of.matrix(pdf["text"].tolist())) if model and len(pdf) else np.zeros(len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, f"id {dict(texts.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
