"""Whole-number vectors: components scaled and rounded down, so that sums and squared distances are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components are below this in magnitude: what squared distances and 32-bit storage hold.
LIMIT = 1 << 22


def finite(vector_col: str) -> Column:
    """A vector that isn't null, without null or non-finite components."""
    return F.coalesce(F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def finite_rows(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v array<double>, and the columns ``more``) of the rows whose vectors are finite. Other columns are dropped, so that none clashes."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *(F.col(c).alias(a) for c, a in zip(more[::2], more[1::2])))
    return rows.where(finite("v"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; an error where they don't fit."""
    out = np.floor(x * float(scale))
    if out.size and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT / scale:g} or more in magnitude: squared distances would not fit")
    return out.astype(np.int64)


def floors(sums: np.ndarray, n: int) -> list[int]:
    """Componentwise floor(sum / count), exactly."""
    return [int(s) // int(n) for s in sums]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of c, by a matrix product in doubles where these are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
