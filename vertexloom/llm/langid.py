"""Language identification by a byte convolutional network trained here in numpy.

Texts are cut into windows of 256 UTF-8 bytes. Filters two, three and four bytes wide run over
a window's bytes, each keeps its largest response (max pooling, at least zero), and a softmax
layer gives the languages' probabilities; a text's are the byte-weighted mean of its windows',
whole text included. A filter over bytes is a sum of one table lookup for each byte; two
neighbouring bytes share one lookup when predicting.

Training uses a bounded sample of labelled texts: about ``PER_LANG`` of each language, and of
each text up to ``WINDOWS`` windows spread over all of it. The label is never a feature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANG = 400
#: Languages that are learned at most: a bound for dirty columns.
LANGS = 300
WINDOWS = 4
EPOCHS = 4
BATCH = 64
#: Windows that are scored at once.
SCORED = 96
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]").search


@dataclass
class Network:
    langs: list[str]
    classes: np.ndarray  # of each byte; 0 is padding
    tables: list[np.ndarray]  # for each width: [width, classes, filters]
    weights: np.ndarray
    bias: np.ndarray


def windows_of(text: bytes) -> np.ndarray:
    """A text's bytes as rows of ``LENGTH``, the last one padded with zeros."""
    rows = max(1, -(-len(text) // LENGTH))
    out = np.zeros(rows * LENGTH, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(rows, LENGTH)


def _pooled(x: np.ndarray, tables: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    where, feats = [], []
    for t in tables:
        w = len(t)
        n = x.shape[1] - w + 1
        s = t[0][x[:, :n]]
        for j in range(1, w):
            s += t[j][x[:, j : j + n]]
        at = s.argmax(axis=1)
        where.append(at)
        feats.append(np.take_along_axis(s, at[:, None, :], axis=1)[:, 0, :])
    return where, np.concatenate(feats, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Network:
    """Fit on windows of at most ``LENGTH`` bytes.

    A third are shortened, to learn short texts, and a sixth are put in capitals.
    """
    rng = np.random.default_rng(seed)
    texts = [t.decode("utf-8", "replace").upper().encode() if up else t for t, up in zip(texts, rng.random(len(texts)) < 1 / 6, strict=True)]
    names = sorted(set(langs))
    x = np.concatenate([windows_of(t[:LENGTH]) for t in texts])
    y = np.array([names.index(v) for v in langs])
    short = rng.random(len(x)) < 1 / 3
    x[short] *= np.arange(LENGTH)[None, :] < rng.integers(12, LENGTH, short.sum())[:, None]
    seen = np.unique(x)
    classes = np.full(256, 1, dtype=np.int64)  # bytes not seen in training share a class
    classes[0] = 0
    classes[seen[seen > 0]] = np.arange(2, 2 + (seen > 0).sum())
    x = classes[x]
    k = int(classes.max()) + 1
    params = [rng.normal(0, 0.3, (w, k, FILTERS)).astype(np.float32) for w in WIDTHS]
    for t in params:
        t[:, :2] = 0
    params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), dtype=np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    step, columns = 0, np.arange(FILTERS)[None, :]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            i = order[a : a + BATCH]
            where, raw = _pooled(x[i], params[:-2])
            feats = np.maximum(raw, 0)
            d = _softmax(feats @ params[-2] + params[-1])
            d[np.arange(len(i)), y[i]] -= 1
            d *= weight[y[i]][:, None] / len(i)
            back = (d @ params[-2].T) * (raw > 0)
            grads = []
            for n, at in enumerate(where):
                g, part = np.zeros_like(params[n]), back[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(len(g)):
                    np.add.at(g[j], (x[i][np.arange(len(i))[:, None], at + j], columns), part)
                g[:, 0] = 0
                grads.append(g)
            grads += [feats.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Network(names, classes.astype(np.uint8), params[:-2], params[-2], params[-1])


class Scorer:
    """A network with its lookups joined: one for bytes t and t + 1, one for t + 2 and t + 3."""

    def __init__(self, net: Network):
        self.net = net
        two, three, four = net.tables
        k = self.k = two.shape[1]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(k * k, -1)
        self.first = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        self.second = np.concatenate([pair(three[2], np.zeros_like(three[2])), pair(four[2], four[3])], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(x), SCORED):
            c = self.net.classes[x[a : a + SCORED]].astype(np.intp)
            c = np.concatenate([c, np.zeros((len(c), 3), dtype=np.intp)], axis=1)
            pairs = c[:, :-1] * self.k + c[:, 1:]
            s = np.take(self.first, pairs[:, :LENGTH], axis=0)
            s[:, :, FILTERS:] += np.take(self.second, pairs[:, 2 : LENGTH + 2], axis=0)
            out.append(_softmax(np.maximum(s.max(axis=1), 0) @ self.net.weights + self.net.bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows, owner, weight, held = [], [], [], 0
        todo = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER(t)]
        total = np.zeros((len(texts), len(self.net.langs)))

        def flush() -> None:
            nonlocal held
            if rows:
                p = self.probabilities(np.concatenate(rows)) * np.concatenate(weight)[:, None]
                np.add.at(total, np.concatenate(owner), p)
            rows.clear(), owner.clear(), weight.clear()
            held = 0

        for i in todo:
            data = texts[i].encode("utf-8", "replace")
            w = windows_of(data)
            for a in range(0, len(w), 4096):
                part = w[a : a + 4096]
                size = np.full(len(part), LENGTH)
                size[-1] = min(LENGTH, len(data) - (a + len(part) - 1) * LENGTH)
                rows.append(part), owner.append(np.full(len(part), i)), weight.append(size)
                held += len(part)
                if held >= 4096:
                    flush()
        flush()
        for i in todo:
            p = total[i] / total[i].sum()
            best = int(p.argmax())
            names[i], scores[i] = self.net.langs[best], float(min(1.0, p[best]))
        return names, scores


def sample(docs: DataFrame, trainable: Column, text_col: str, lang_col: str, key_col: str, per_lang: int = PER_LANG) -> tuple[list[bytes], list[str]]:
    """About ``per_lang`` texts of each language, chosen by a hash of the key; windows of each.

    The ``LANGS`` languages with the most rows are learned (ties: the lesser name first).
    """
    rows = docs.where(trainable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGS).collect()}
    if not counts:
        return [], []
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*[F.lit(min(1.0, per_lang / n)) for n in counts.values()])), F.col(lang_col))
    # a quarter more than the bound at most, whatever the hash does
    chosen = rows.where(F.pmod(F.xxhash64(F.col(key_col)), F.lit(1 << 20)) < share * (1 << 20)).limit(int(1.25 * per_lang * len(counts)) + 50)
    spread = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring(
        F.col(text_col), (F.floor(F.greatest(F.length(text_col) - LENGTH, F.lit(0)) * i / (WINDOWS - 1)) + 1).cast("int"), F.lit(LENGTH)))
    got = chosen.select(F.col(lang_col).alias("lang"), F.array_distinct(spread).alias("w")).sort("lang", "w").collect()
    pairs = [(w.encode("utf-8", "replace"), r["lang"]) for r in got for w in r["w"]]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def identify(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text when
    there is nothing to learn from. Texts of any length are read whole. Equal texts get equal
    predictions; of equally likely languages the first by name is taken. Repeated rows each get
    a row; an empty table gives an empty table. Only the named columns are read, so others may
    have any name; the language is read only where ``trainable`` holds.
    """
    texts, langs = sample(docs, trainable, text_col, lang_col, id_col)
    net = train(texts, langs) if texts else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net) if net else None
        for pdf in batches:
            names, scores = scorer.predict(pdf["text"].tolist()) if scorer else ([UNKNOWN] * len(pdf), [0.0] * len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": names, "score": scores})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
