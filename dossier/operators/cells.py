"""Exact nearest vectors that read few of them: cells around pivots, stored as partitions, and bounds by the triangle inequality.

Each vector is in the cell of its nearest pivot and is stored with its distance from it. For a query at distance d from a pivot, a vector at distance f
from the same pivot is no nearer than |d - f|. Cells are visited in the order of what their smallest and largest f allow; when the k-th
nearest so far is nearer than what the next cell allows, the rest are left out, and in a cell only rows whose own f allows more are looked at.
Pivots are rows (those with the smallest hashes of their ids, at most ``PIVOTS``), so their number is bounded and any
choice gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import literal, squared_distance
from ..sources.scratch import shared

PIVOTS = 64
#: Files that a cell is dealt to at most, so that a hot one isn't one task's.
SPREAD = 8
#: What rounding can make of a bound.
SLACK = 1e-6


@dataclass
class Cells:
    """A table of cells: (id, vector, far) in partitions by cell, the pivots, and (rows, smallest far, largest far) of each cell."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    id_col: str
    vector_col: str
    ranges: dict[int, tuple[int, float, float]]
    #: The cells that the last search read.
    read: list[int] = field(default_factory=list)

    def nearest(self, vector: list[float], limit: int) -> DataFrame:
        """(id, distance): the rows whose vectors are nearest, with the squared distance; ties go to the smaller id."""
        none = self.spark.read.parquet(self.path).select(self.id_col, F.lit(0.0).alias("distance")).limit(0) if self.ranges else None
        if not self.ranges or limit <= 0:
            return none if none is not None else self.spark.createDataFrame([], f"{self.id_col} long, distance double")
        away = np.sqrt(((self.pivots - np.asarray(vector, np.float64)) ** 2).sum(1))
        bound = {c: max(0.0, away[c] - high, low - away[c]) for c, (_, low, high) in self.ranges.items()}
        order = sorted(bound, key=lambda c: (bound[c], away[c], c))
        # the first cells that have enough rows say how far the k-th nearest is at most
        first, rows = [], 0
        for c in order:
            first.append(c)
            rows += self.ranges[c][0]
            if rows >= limit:
                break
        reach = self._within(first, away, math.inf, vector, limit).agg(F.max("distance").alias("d"), F.count("*").alias("n")).first()
        worst = math.sqrt(reach.d) * (1 + SLACK) + SLACK if reach.n == limit else math.inf
        self.read = [c for c in order if bound[c] <= worst]
        return self._within(self.read, away, worst, vector, limit)

    def _within(self, cells: list[int], away: np.ndarray, reach: float, vector: list[float], limit: int) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where(F.col("cell").isin(cells))
        if reach < math.inf:
            own = F.element_at(F.create_map(*(x for c in cells for x in (F.lit(c), F.lit(float(away[c]))))), F.col("cell"))
            rows = rows.where(F.abs(F.col("far") - own) <= reach)
        return rows.select(self.id_col, squared_distance(F.col(self.vector_col), literal(vector)).alias("distance")).orderBy("distance", self.id_col).limit(limit)


def build(rows: DataFrame, path: str | None = None, vector_col: str = "vector", id_col: str = "chunk_id", pivots: int = PIVOTS) -> Cells:
    """Write the cells of all rows with a vector; vectors have one length and finite components. path: a new folder; a scratch one without."""
    spark = rows.sparkSession
    path = path or f"{shared(spark)}/cells-{np.random.default_rng().integers(1 << 62):x}"
    vectors = rows.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    chosen = np.array([r[vector_col] for r in vectors.orderBy(F.xxhash64(id_col), id_col).limit(pivots).collect()], np.float64)
    if not len(chosen):
        return Cells(spark, path, chosen, id_col, vector_col, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            cell = ((chosen**2).sum(1)[None, :] - 2 * x @ chosen.T).argmin(1)
            far = np.sqrt(((x - chosen[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*b.schema.names, "cell", "far"])

    kinds = dict(vectors.dtypes)
    made = vectors.mapInArrow(run, f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, cell int, far double")
    made.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(SPREAD))).sortWithinPartitions("cell", "far").write.partitionBy("cell").parquet(path)
    sums = spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    return Cells(spark, path, chosen, id_col, vector_col, {r.cell: (r.n, r.low, r.high) for r in sums.collect()})
