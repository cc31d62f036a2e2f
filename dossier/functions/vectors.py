"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, summed in the order of the components."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def zero(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
