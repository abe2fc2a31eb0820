"""The operators that learn: held-out accuracy, awkward rows, and the learners themselves."""

from __future__ import annotations

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from vertexloom.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = langid.op7_language_id(spark, SF).join(docs, "doc_id").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_language_edges(spark):
    docs = documents(spark, ["the cat and the dog", None, "", "123 ...", "der Hund und die Katze", "the cat and the dog"] + ["the cat and the dog " * 20_000])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 4, "de").otherwise("en"))
    got = {r["doc_id"]: r for r in langid.identify(docs, F.lit(True)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[0]["lang_pred"] == got[5]["lang_pred"] in ("en", "de")
    assert langid.identify(docs, F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_network_scores_like_it_trains():
    net = langid.train([b"aaaa bbbb", b"cccc dddd"] * 20, ["x", "y"] * 20)
    x = langid.windows_of(b"aaaa cccc bbb")
    raw = np.maximum(langid._pooled(net.classes[x].astype(int), net.tables)[1], 0)
    assert np.allclose(langid._softmax(raw @ net.weights + net.bias), langid.Scorer(net).probabilities(x), atol=1e-4)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.93 and (neg >= 0.5).mean() < 0.01 and (pos >= 0.5).mean() > 0.8


def test_toxicity_edges(spark):
    docs = documents(spark, [None, "", "you idiot", "you idiot", "fine text " * 50_000], [1, 2, 3, 3, None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, none, F.lit(True)).collect()
    assert len(got) == 5 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in got)
    one_sided = spark.createDataFrame([(1, 0, 1), (2, None, None), (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, one_sided, F.lit(True)).count() == 5
    assert toxicity.score(docs.limit(0), none, F.lit(True)).count() == 0
    assert toxicity.score(docs, one_sided, F.lit(True)).columns == ["doc_id", "score", "predicted"]


def test_samples_are_bounded(spark, monkeypatch):
    """However often ids or languages repeat, no more than the documented bounds is learned from."""
    docs = documents(spark, [f"text {i} idiot" for i in range(300)], [i % 3 for i in range(300)])
    labels = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows, _ = toxicity.labelled(docs, labels, F.lit(True), "doc_id", "text", 100)
    assert sorted((r["id"], r["text"]) for r in rows.collect()) == [(0, "text 0 idiot"), (1, "text 1 idiot"), (2, "text 101 idiot")]
    monkeypatch.setattr(langid, "LANGS", 2)
    many = docs.withColumn("lang", F.concat(F.lit("l"), (F.monotonically_increasing_id() % 50).cast("string")))
    assert len(set(langid.sample(many, F.lit(True), "text", "lang", "text")[1])) == 2


def test_features():
    f = toxicity.Features(frozenset({"zorg~", "blap"}))
    x = dict(zip(toxicity.NAMES, f.of("You IDIOT! zorgles are 1d1ot blap."), strict=True))
    assert x["hits"] == 4 and x["near_second"] > 0 and x["obfuscated"] > 0 and x["capital_words"] > 0
    assert toxicity.deobfuscated("1d.i0ooot") == "idiot"
    assert np.isfinite(f.matrix([None, "", "\ud800", "a" * 100_000])).all()


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = toxicity.boost(x, y, np.ones(600))
    assert ((model.margin(x) > 0) == y).mean() > 0.95
    at, level = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all() and level.tolist() == [0, 0.5, 1]


def test_repeated_letters_of_a_long_text():
    f = toxicity.Features(frozenset())
    text = "sooo bad " * (1 << 19)
    assert len(text) > 1 << 22 and dict(zip(toxicity.NAMES, f.of(text), strict=True))["repeated_letters"] == 0.5
