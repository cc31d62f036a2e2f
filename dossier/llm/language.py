"""Language identification in two steps: the family first, then the language within it.

Features of a text are the counts of its character n-grams (one to three
letters, lower-cased, all else as one space between words), hashed to DIM
places, as square roots of unit length. Linear support vector machines tell
each pair of families apart, and within a family each pair of languages: one
against one, by votes weighted with their certainty. Languages that no family lists are a family
of their own name.

Models are fitted on a bounded sample: at most ``per_language`` training rows
of each language, those with the smallest hash of their id. Every text is then judged whole.

A null text, or one without a letter, is ``und`` with score 0. With a single
learned language every text with letters gets it, with score 1; with none all are ``und``. Rows that repeat
fare alike, also in the sample, where ids whose hashes are equal come in order; of classes with equal votes the first by name wins;
very long texts count whole; an empty table gives an empty result; null labels aren't learned from; rows with a null id are never held out; other columns are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, map_rows

DIM = 1 << 12
PER_LANGUAGE, STEPS, PENALTY = 400, 120, 1e-4
#: Parts of a language in which its sample is first chosen.
SALTS = 64
#: Languages by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "ur", "pa", "mr", "gu", "ne"],
    "sinitic": ["zh", "yue"],
}


def family_of(language: str) -> str:
    short = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, of in FAMILIES.items() if short in of), language)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _places(text: str) -> np.ndarray | None:
    """The hashed places of all n-grams; None without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = c[letter | np.concatenate([[True], letter[:-1]])]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    grams = [c]
    if len(c) > 1:
        grams.append((c[:-1] * np.uint32(0x01000193)) ^ c[1:] ^ np.uint32(0x5BD1E995))
    if len(c) > 2:
        grams.append((((c[:-2] * np.uint32(0x01000193)) ^ c[1:-1]) * np.uint32(0x01000193)) ^ c[2:] ^ np.uint32(0x1B873593))
    h = np.concatenate(grams) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(20)


def features(text: str | None) -> np.ndarray | None:
    places = _places(text or "")
    if places is None:
        return None
    x = np.sqrt(np.bincount(places, minlength=DIM))
    return (x / np.linalg.norm(x)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(1, STEPS + 1):
        slack = np.maximum(0, 1 - y * (x @ v))
        g = -2 * (weight * y * slack) @ x + PENALTY * v
        new = v - 0.25 * g
        v = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Vote:
    """Machines that tell each two of some classes apart."""

    classes: list[str]
    weights: np.ndarray
    constants: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray, classes: list[str]) -> Vote:
        made = []
        for a, b in combinations(classes, 2):
            rows = (labels == a) | (labels == b)
            made.append(fit_svm(x[rows], np.where(labels[rows] == a, 1, -1).astype(np.float32)))
        weights = np.array([m[0] for m in made], np.float32).reshape(-1, DIM)
        return Vote(classes, weights, np.array([m[1] for m in made]))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        total = dict.fromkeys(self.classes, 0.0)
        for (a, b), margin in zip(combinations(self.classes, 2), self.weights @ x + self.constants):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * float(margin)))))
            total[a] += p
            total[b] += 1 - p
        best = max(self.classes, key=lambda c: total[c])
        return best, total[best] / (len(self.classes) - 1)


@dataclass
class Model:
    family: Vote | None
    within: dict[str, Vote]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or self.family is None:
            return "und", 0.0
        family, p = self.family.predict(x)
        language, q = self.within[family].predict(x)
        return language, p * q


def held_out(id_col: str) -> Column:
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows that aren't held out and have a text and a language."""
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL AND lang IS NOT NULL")
    # first within parts of a language, so that no task sees more of it than SALTS times per_language
    ids = rows.select("id", "lang").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)))
    for by in (("lang", "salt"), ("lang",)):
        nth = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64("id"), "id"))
        ids = ids.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")
    ids = ids.select(F.col("id").alias("chosen")).distinct()
    sample = rows.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("chosen")), "left_semi")  # per_language ids of each language

    def make():
        def row(lang, text):
            x = features(text)
            return (lang, None if x is None else x.astype(np.float16).tobytes())

        return row

    found = [r for r in map_rows(sample.select("lang", "text"), make, "lang string, x binary").orderBy("lang", "x").collect() if r.x is not None]
    if not found:
        return Model(None, {})
    x = np.frombuffer(b"".join(r.x for r in found), np.float16).reshape(-1, DIM).astype(np.float32)
    languages = np.array([r.lang for r in found])
    families = np.array([family_of(r.lang) for r in found])
    by_family = {f: sorted(set(languages[families == f])) for f in sorted(set(families))}
    within = {f: Vote.fit(x[families == f], languages[families == f], of) for f, of in by_family.items()}
    return Model(Vote.fit(x, families, list(by_family)), within)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = sent.value.predict
        return lambda key, held, text: (key, held, *predict(text))

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, held_out(id_col).alias("held_out"), text_col), make, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
