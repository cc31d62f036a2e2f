import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import toxicity

CATEGORIES = toxicity.CATEGORIES


def test_accuracy_on_rows_not_fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"), CATEGORIES)
    out = toxicity.classify(docs, model).select("doc_id", F.col("toxic").alias("found"), "p_toxic").join(labels.where("doc_id % 4 = 0"), "doc_id")
    r = out.agg(F.avg((F.col("found") == (F.col("toxic") == 1)).cast("double")).alias("right")).first()
    assert r.right >= 0.93


def test_fit_and_threshold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3)).astype(np.float32)
    w = toxicity.fit_one(x, (x[:, 0] > 0).astype(np.float32))
    assert ((toxicity.predict_one(x, w) > 0.5) == (x[:, 0] > 0)).mean() > 0.95
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0])) == (0.8 + 0.1) / 2


def test_chain_feeds_earlier_probabilities(monkeypatch):
    """Each model of a fold is fitted on the rows and features of the others, and later ones see the earlier categories' out-of-fold probabilities."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 4)).astype(np.float32)
    labels = np.stack([x[:, 0] > 0, x[:, 0] > 0.5], 1).astype(np.float32)
    labels[::7, 1] = -1
    fold = np.arange(90) % toxicity.FOLDS
    masks = {None: np.ones(4, bool), **{k: np.arange(4) != k + 1 for k in range(toxicity.FOLDS)}}
    seen, fit_one = [], toxicity.fit_one
    monkeypatch.setattr(toxicity, "fit_one", lambda a, y: seen.append((a, y)) or fit_one(a, y))
    weights, thresholds = toxicity.fit_chain(x, labels, fold, masks)
    assert [len(w) for w in weights] == [5, 6] and len(thresholds) == 2 and len(seen) == 2 * (toxicity.FOLDS + 1)
    for k in range(toxicity.FOLDS):
        a, y = seen[k]
        assert (a == (x * masks[k])[fold != k]).all() and (y == labels[fold != k, 0]).all()
    out = np.zeros(90, np.float32)
    for k in range(toxicity.FOLDS):
        out[fold == k] = toxicity.predict_one((x * masks[k])[fold == k], fit_one((x * masks[k])[fold != k], labels[fold != k, 0]))
    a, y = seen[-1]
    has = labels[:, 1] >= 0
    assert (a[:, :4] == x[has]).all() and np.allclose(a[:, 4], out[has]) and weights[1][4] > 0


def test_classify_as_a_loop(spark):
    """Probabilities of the given table from the words of each text, category by category."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, CATEGORIES)
    width = len(model.features)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        tally = toxicity.counts(d.text)
        p = []
        for w in model.weights:
            z = float(w[-1]) + sum(float(w[at]) * math.log1p(tally[f]) for f, at in model.features.items() if tally[f]) + sum(float(w[width + k]) * q for k, q in enumerate(p))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        r = got[d.doc_id]
        assert (r.p_quality, r.p_toxic) == pytest.approx(p, abs=1e-9) and r.toxic == (r.p_toxic >= model.thresholds[1])


def test_features_of_a_fold(spark):
    """A word that only one fold's rows have is none of that fold's features."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} word{i % 3} text") for i in range(120)], "doc_id long, text string")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.FOLDS)).cast("int").alias("f")).collect()}
    docs = docs.withColumn("text", F.concat("text", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.FOLDS)) == 0, " onlyzero").otherwise("")))
    seen = []
    plain = toxicity.fit_chain
    try:
        toxicity.fit_chain = lambda x, y, f, masks: seen.append((f, masks)) or plain(x, y, f, masks)
        model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")), CATEGORIES)
    finally:
        toxicity.fit_chain = plain
    (folds, masks), = seen
    assert sorted(folds) == sorted(fold.values())
    at = model.features["=onlyzero"]
    assert masks[None][at] and not masks[0][at] and masks[1][at]


def test_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, 1), (7, None, 1), (3, 1, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, CATEGORIES)
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    none = toxicity.fit(odd, labels.limit(0), CATEGORIES)
    assert not any(r.toxic for r in toxicity.classify(odd, none).collect())
    assert toxicity.classify(empty, model).count() == 0
    assert toxicity.classify(odd, model, keep=True).columns == [*odd.columns, "verdict"]
