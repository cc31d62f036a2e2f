"""Connected components of links between ids, as joins and aggregations that repeat until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stash_path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): the smallest id that each linked id reaches; see components_path."""
    return links.sparkSession.read.parquet(components_path(links, a, b))


def components_path(links: DataFrame, a: str = "a", b: str = "b") -> str:
    """A table of (id, component_id): the smallest id that each linked id reaches.

    links holds undirected links; loops and repeats do no harm and ids that
    are null link nothing. Each round, every id takes the smallest label of
    itself and its neighbours, then the label of that label; a hub's
    neighbours are pre-aggregated, so that no task holds a whole group. Rounds
    grow with the logarithm of the longest path in practice. The rounds' tables are
    written to the shared folder and dropped when the next one is there.
    """
    spark = links.sparkSession
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both_at = stash_path(links.union(links.select("b", "a")).distinct(), "links")
    both = spark.read.parquet(both_at)
    at = stash_path(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component_id")), "labels")
    while True:
        labels = spark.read.parquet(at).select("id", F.col("component_id").alias("label"))
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        better = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        moved = better.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("component_id"), F.col("label").alias("old"))
        was, at = at, stash_path(moved, "labels")
        changed = spark.read.parquet(at).where("old <> component_id").limit(1).count()
        drop_path(spark, was)
        if not changed:
            drop_path(spark, both_at)
            return at


def extend_path(groups_at: str, links: DataFrame) -> str:
    """A table of (id, component_id) with the links (a, b) added to the components at groups_at, which is dropped.

    Only the components that new links join are searched, as ids of their own.
    """
    spark = links.sparkSession
    groups = spark.read.parquet(groups_at).select("id", "component_id")
    ends = links.join(groups.select(F.col("id").alias("a"), F.col("component_id").alias("c")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component_id").alias("d")), "b", "left")
    between_at = stash_path(ends.select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b")).where("a <> b").distinct(), "between")
    between = spark.read.parquet(between_at)
    joined_at = components_path(between)
    joined = spark.read.parquet(joined_at).select(F.col("id").alias("was"), F.col("component_id").alias("now"))
    # an id that had no link is a component of itself
    known = groups.select("id", F.col("component_id").alias("was")).union(joined.join(groups, joined["was"] == groups["id"], "left_anti").select("was", "was"))
    at = stash_path(known.join(joined, "was", "left").select("id", F.coalesce("now", "was").alias("component_id")), "labels")
    for done in (groups_at, between_at, joined_at):
        drop_path(spark, done)
    return at
