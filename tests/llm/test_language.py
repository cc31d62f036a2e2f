import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import language


def test_held_out_accuracy(spark, documents):
    out = language.identify(documents, language.fit(documents, 60)).join(documents.select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.right >= 0.95 and 0 <= r.low and r.high <= 1


def test_edges(odd, empty):
    model = language.fit(odd, 5)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert by[None].held_out is False and by[1].lang_pred == by[6].lang_pred
    assert {r.lang_pred for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_families():
    assert language.family_of("en-GB") == language.family_of("de") != language.family_of("fr") and language.family_of("xx") == "xx"


def votes(vote, x):
    """The class with the largest sum of certainties over all pairs, and its mean certainty."""
    if len(vote.classes) == 1:
        return vote.classes[0], 1.0
    total = {c: 0.0 for c in vote.classes}
    for k, (a, b) in enumerate(combinations(vote.classes, 2)):
        margin = sum(float(w) * float(f) for w, f in zip(vote.weights[k], x) if f) + float(vote.constants[k])
        p = 1 / (1 + math.exp(-3 * margin))
        total[a] += p
        total[b] += 1 - p
    best = sorted(vote.classes, key=lambda c: -total[c])[0]
    return best, total[best] / (len(vote.classes) - 1)


def test_votes_as_a_loop(spark, documents):
    """Of the query's table: the family by votes, then the language by votes within it."""
    model = language.fit(documents, 20)
    rows = {r.doc_id: r for r in language.identify(documents, model).collect()}
    assert len(rows) == documents.count()
    for d in documents.limit(40).collect():
        x = language.features(d.text)
        family, p = votes(model.family, x)
        best, q = votes(model.within[family], x)
        assert rows[d.doc_id].lang_pred == best and abs(rows[d.doc_id].score - p * q) < 1e-4


def test_features_as_a_loop():
    text = "Ab\u00e7, 12 d!"
    kept = [c for k, c in enumerate(text.lower()) if c.isalpha() or k == 0 or text.lower()[k - 1].isalpha()]
    plain = " " + "".join(c if c.isalpha() else " " for c in kept) + " "
    grams = [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)]
    assert len(language._places(text)) == len(grams) and len(set(language._places(text).tolist())) <= len(set(grams))
    assert abs(np.linalg.norm(language.features(text)) - 1) < 1e-6


def test_sample_is_the_smallest_hashes(spark):
    """At most so many rows of each language, whatever the parts."""
    rows = [(i, "abc" if i % 5 else "xyz", "en" if i % 5 else "fr") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, 7)
    assert sorted(model.within) == ["germanic", "romance"]
    out = language.identify(df, model)
    assert out.where((F.col("doc_id") % 5 == 0) != (F.col("lang_pred") == "fr")).count() == 0
