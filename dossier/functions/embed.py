"""Embedders are callables from a text column to a vector column: of models, which are loaded once in each worker, and two that need no model and always give the same."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Characters of a text that a model gets, and texts of a call.
MAX_CHARS, BATCH = 8000, 96

#: A model: (position, vector) for each of the texts of a call, in any order.
Model = Callable[[list[str]], list[tuple[int, list[float]]]]


def embed_batch(model: Model, texts: list[str | None], retries: int = 3, wait_seconds: float = 0.5) -> list[list[float]]:
    """The vectors of one call's texts, by position. Texts are cut, and empty and null ones are a space. A call that fails, or
    doesn't answer every position once, is made again, each time after twice the wait; its last error is raised."""
    asked = [(t or "")[:MAX_CHARS] or " " for t in texts]
    for turn in range(retries + 1):
        try:
            found = dict(answers := model(asked))
            if len(answers) != len(asked) or set(found) != set(range(len(asked))):
                raise ValueError(f"{len(asked)} texts were asked, positions {sorted(found)} answered")
            return [[float(x) for x in found[i]] for i in range(len(asked))]
        except Exception:
            if turn == retries:
                raise
            time.sleep(wait_seconds * 2**turn)
    raise AssertionError


def model_embedder(load: Callable[[], Model], batch: int = BATCH, retries: int = 3, wait_seconds: float = 0.5) -> Callable[[Column], Column]:
    """Vectors of a model that ``load`` makes once in each task; calls have at most ``batch`` texts and don't cross Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in parts:
            model = model or load()
            listed = [None if t is None or t is pd.NA else t for t in texts]
            out: list[list[float]] = []
            for start in range(0, len(listed), batch):
                out += embed_batch(model, listed[start : start + batch], retries, wait_seconds)
            yield pd.Series(out)

    return embed


def keyword_embedder(keywords: list[str]) -> Callable[[Column], Column]:
    """1.0 where the text holds a keyword, else 0.01."""

    def embed(text: Column) -> Column:
        body = F.lower(F.substring(text, 1, MAX_CHARS))
        return F.array(*(F.when(body.contains(k), 1.0).otherwise(0.01).cast("float") for k in keywords))

    return embed


def hash_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """Counts of hashed words, scaled to length 1; blank texts give a single mark."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.substring(text, 1, MAX_CHARS)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float"))

    return embed
