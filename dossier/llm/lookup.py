"""Joins of many rows with a table of one row for each key, whatever the keys' shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is sent to all tasks; a larger one is joined by shuffle.
SENT_ROWS = 20_000
#: Parts that the rows of one key are dealt to in that join.
PARTS = 64


def attach(rows: DataFrame, table: DataFrame, key: str, spread: str, most: int = SENT_ROWS, parts: int = PARTS) -> DataFrame:
    """rows with the other columns of table, null where it lacks the key. Null keys meet each other.

    table has one row for each key and is read twice, so it should be a written one. Its rows are counted: up to ``most`` of them
    are sent to all tasks. Beyond that, rows of a key are dealt by the column ``spread`` to ``parts`` parts, each of
    which meets a copy of the key's row, so that no task gets all rows of a hot key.
    """
    there = table.select(F.col(key).alias("__key"), *(c for c in table.columns if c != key))
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(there), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    copied = there.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copied, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")), "left").drop("__key", "__part", "__at")
