"""Toxicity by a classifier chain of linear models over words and word beginnings.

Categories are predicted one after another. Each model is a logistic
regression over the counts of selected words and word beginnings, and over
the probabilities of all earlier categories. While training, those
probabilities come from models that have not seen the row (out of fold), so
that later models learn how far earlier ones can be trusted; in prediction
they come from the earlier models fitted on all rows.

The chain is fitted on a bounded sample of labelled rows (``max_rows``, those
with the smallest hash of their id); every text is then classified whole.

Rows with a null or empty text get the probabilities of a text without any
selected word. Labels that are null are left out of their category's model,
repeated label rows count once each, and a category without both labels
predicts its share of positives (0 without labels). Features that gain equally
are taken in the order of their text, and rows whose ids hash alike in the order of their labels.
Very long texts count whole; an empty table gives an empty result. Other columns are
dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import add_column, drop_path, map_rows, stash_path

#: Letters of one word; digits and underscores end it.
LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features besides the word itself.
BEGINNINGS = (4, 5, 6)
#: Features that are selected for each category, and rows that each must occur in.
SELECTED, LEAST_ROWS = 512, 5
FOLDS, STEPS, DECAY = 3, 150, 1e-4
#: Words whose features a task remembers.
REMEMBERED = 50_000


def parts(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, which are told apart by a mark."""
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def counts(text: str | None) -> Counter:
    found = Counter(LETTERS.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in found.items():
        for part in parts(word):
            out[part] += n
    return out


@dataclass
class Chain:
    """Models of the categories in order: weights of features, then of earlier categories, then the constant."""

    features: dict[str, int]
    categories: tuple[str, ...]
    weights: list[np.ndarray]
    thresholds: list[float] = field(default_factory=list)

    def classifier(self):
        known: dict[str, tuple[int, ...]] = {}
        features, width = self.features, len(self.features)

        def probabilities(text: str | None) -> list[float]:
            if len(known) > REMEMBERED:
                known.clear()
            ids = []
            for word in LETTERS.findall((text or "").lower()):
                found = known.get(word)
                if found is None:
                    found = known[word] = tuple(features[p] for p in parts(word) if p in features)
                if found:
                    ids.append(found)
            tally = Counter(chain.from_iterable(ids))
            out: list[float] = []
            for w in self.weights:
                z = float(w[-1]) + sum(float(w[i]) * math.log1p(n) for i, n in tally.items()) + sum(float(w[width + k]) * p for k, p in enumerate(out))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            return out

        return probabilities


def fit_one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a little weight decay, by Adam over all rows; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
    w[-1] = math.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    m = np.zeros_like(w)
    v = np.zeros_like(w)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        off = (p - y).astype(np.float32)
        g = np.append(off @ x, off.sum()) / len(y) + DECAY * np.append(w[:-1], 0).astype(np.float32)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w = w - (0.3 / (1 + 0.02 * t)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float32)


def predict_one(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is best out of fold: the middle of the gap below the last row that is taken."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def gains(by_word: DataFrame, totals: Row, category: str, fold: int | None) -> DataFrame:
    """(w, gain): how far a feature's share of positives is from all rows' share, over the rows of all folds but one."""
    folds = [k for k in range(FOLDS) if k != fold]
    n, hits = (sum(F.col(f"{c}_{k}") for k in folds) for c in ("n", category))
    share = (sum(totals[f"{category}_{k}"] or 0 for k in folds) + 0.5) / (sum(totals[f"n_{k}"] for k in folds) + 1)
    expected = n * F.lit(share)
    return by_word.where(n >= LEAST_ROWS).select("w", ((hits - expected) * (hits - expected) / (expected * F.lit(1 - share))).alias("gain"))


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain on at most max_rows labelled rows. Each category is a 0/1 column of labels.

    Folds are made of ids, so that rows that repeat one are together. A fold's
    features are chosen, and its models fitted, on the rows of the others.
    """
    spark = docs.sparkSession
    sample = labels.select(id_col, *categories).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), *categories).limit(max_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # at most max_rows ids
    key = f"{id_col} {dict(docs.dtypes)[id_col]}"

    def make():
        return lambda *v: (*v[:-1], [(k, n) for k, n in sorted(counts(v[-1]).items())])

    kinds = ", ".join(f"{c} int" for c in categories)
    counted_at = stash_path(map_rows(rows.select(id_col, *(F.col(c).cast("int").alias(c) for c in categories), text_col), make, f"{key}, {kinds}, words array<struct<w: string, n: int>>"), "counted")
    counted = spark.read.parquet(counted_at)
    fold_of = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(FOLDS)).cast("int")
    tallies = [F.coalesce(F.sum(F.when(F.col("fold") == k, x)), F.lit(0)).alias(f"{c}_{k}") for k in range(FOLDS) for c, x in (("n", F.lit(1)), *((c, F.col(c).cast("long")) for c in categories))]
    folded = counted.withColumn("fold", fold_of)
    totals = folded.agg(*tallies).first()
    by_word_at = stash_path(folded.select(*categories, "fold", F.explode("words.w").alias("w")).groupBy("w").agg(F.count("*").alias("all"), *tallies).where(F.col("all") >= LEAST_ROWS), "features")
    by_word = spark.read.parquet(by_word_at)
    features: dict[str, int] = {}
    seen_by: dict[int | None, set[int]] = {}
    for fold in (None, *range(FOLDS)):
        seen_by[fold] = set()
        for c in categories:
            for row in gains(by_word, totals, c, fold).orderBy(F.desc("gain"), "w").limit(SELECTED).collect():
                seen_by[fold].add(features.setdefault(row.w, len(features)))
    wanted = spark.sparkContext.broadcast(features)

    def only():
        table = wanted.value
        return lambda *v: (*v[:-1], np.array([(table[x["w"]], x["n"]) for x in v[-1] if x["w"] in table], np.int32).tobytes())

    # at most max_rows rows of at most len(features) pairs of numbers
    sparse = map_rows(folded.select("fold", id_col, *categories, "words"), only, f"fold int, {key}, {kinds}, words binary").orderBy(id_col, *categories, "words").collect()
    for at in (counted_at, by_word_at):
        drop_path(spark, at)

    x = np.zeros((len(sparse), len(features)), np.float32)
    for i, row in enumerate(sparse):
        pairs = np.frombuffer(row.words, np.int32).reshape(-1, 2)
        x[i, pairs[:, 0]] = np.log1p(pairs[:, 1])
    labelled = np.array([[-1 if row[c] is None else row[c] for c in categories] for row in sparse], np.float32).reshape(-1, len(categories))
    masks = {fold: np.isin(np.arange(len(features)), list(of)) for fold, of in seen_by.items()}
    weights, thresholds = fit_chain(x, labelled, np.array([row.fold for row in sparse], np.int64), masks)
    return Chain(features, categories, weights, thresholds)


def fit_chain(x: np.ndarray, labelled: np.ndarray, fold: np.ndarray, masks: dict[int | None, np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """(weights, thresholds) of each category in order. labelled has -1 where a label is missing; masks has the features of each fold, and of all rows under None."""
    weights, thresholds = [], []
    earlier = np.zeros((len(x), 0), np.float32)
    for y in labelled.T:
        has = y >= 0
        out = np.zeros(len(x), np.float32)
        for k in range(FOLDS):
            own = np.hstack([x * masks[k], earlier])
            w = fit_one(own[has & (fold != k)], y[has & (fold != k)])
            out[fold == k] = predict_one(own[fold == k], w)
        weights.append(fit_one(np.hstack([x * masks[None], earlier])[has], y[has]))
        thresholds.append(best_threshold(out[has], y[has]))
        earlier = np.hstack([earlier, out[:, None]])
    return weights, thresholds


def classify(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, into: str = "verdict") -> DataFrame:
    """(id, p_<category>..., <category>...): each category's probability and whether it reaches the threshold.

    With keep, all columns of docs stay and one column, ``into``, with the
    probabilities in order is added instead.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    if keep:
        return add_column(docs, [text_col], lambda: sent.value.classifier(), into, "array<double>")

    def make():
        work, at = sent.value.classifier(), sent.value.thresholds

        def row(key, text):
            p = work(text)
            return (key, *p, *(a >= b for a, b in zip(p, at)))

        return row

    kinds = ", ".join([f"{id_col} {dict(docs.dtypes)[id_col]}", *(f"p_{c} double" for c in model.categories), *(f"{c} boolean" for c in model.categories)])
    return map_rows(docs.select(id_col, text_col), make, kinds)


#: The chain of the given labels: quality is judged first, then toxicity.
CATEGORIES = ("quality", "toxic")
