"""The corpus manifest: search, overview, lookups, page slices within a budget, and the trial sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET_CHARS = 24_000
NONE = "(none)"
LISTED = ("key", "asset_team", "well", "category", "entry_type", "parse_source")


def search_documents(manifest: DataFrame, asset_team="", well="", entry_type="", key_contains="", parse_source="", limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(total_matches as a row, at most limit rows of six columns in manifest order). Empty filters are off."""
    rows = manifest
    for column, value in (("asset_team", asset_team), ("entry_type", entry_type), ("parse_source", parse_source)):
        if value:
            rows = rows.where(F.col(column) == value)
    for column, value in (("well", well), ("key", key_contains)):
        if value:
            rows = rows.where(F.lower(column).contains(value.lower()))
    order = "ordinal" if "ordinal" in manifest.columns else "key"
    return rows.agg(F.count("*").alias("total_matches")), rows.orderBy(order).select(*LISTED).limit(limit)


def overview(manifest: DataFrame, dimensions: tuple[str, ...] = ("asset_team", "entry_type", "parse_source")) -> DataFrame:
    """(dimension, value, n): counts by each dimension in one pass, and the total; empty values are '(none)'."""
    named = [F.when(F.coalesce(F.col(d), F.lit("")) == "", NONE).otherwise(F.col(d)).alias(d) for d in dimensions]
    rows = manifest.select(*named)
    each = rows.select(F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions))).alias("x"))
    return each.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n")).orderBy("dimension", F.desc("n"), "value")


def split_known(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """The keys with their manifest row and whether they are known."""
    return keys.join(manifest.withColumn("known", F.lit(True)), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_seen(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The first row of each key. The window's filter is applied before the shuffle, per task."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(ordinal))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def slice_pages(pages: DataFrame, group: str, page_start: int | None = None, page_end: int | None = None, budget: int = BUDGET_CHARS, page_col: str = "page", text_col: str = "markdown") -> DataFrame:
    """Pages in range while their lengths fit the budget; a first page over the budget gives its head."""
    rows = pages
    if page_start is not None:
        rows = rows.where(F.col(page_col) >= page_start)
    if page_end is not None:
        rows = rows.where(F.col(page_col) <= page_end)
    by = W.partitionBy(group).orderBy(page_col)
    rows = rows.withColumn("until", F.sum(F.length(text_col)).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("nth", F.row_number().over(by))
    kept = rows.where((F.col("until") <= budget) | (F.col("nth") == 1))
    return kept.withColumn(text_col, F.substring(text_col, 1, budget)).drop("until", "nth")


def batch_cap(listing: DataFrame, max_new: int, is_new: str, ordinal: str) -> DataFrame:
    """Rows in order before the pass stops: it stops when max_new new ones are done. Rows of one ordinal stay together.

    Only the first max_new ordinals of new rows meet, to find the last one; the rows themselves stay where they are.
    """
    first = listing.where(F.col(is_new)).select(F.col(ordinal).alias("o")).orderBy("o").limit(max_new)
    last = first.agg(F.max("o").alias("__last"), (F.count("*") < max_new).alias("__all"))
    return listing.crossJoin(F.broadcast(last)).where(F.col("__all") | (F.col(ordinal) <= F.col("__last"))).drop("__last", "__all")  # last is one row


def trial_sample(rows: DataFrame, n: int, buckets: tuple[str, str] = ("asset_team", "parse_source"), key: str = "key") -> DataFrame:
    """(pick, key): a stratified sample of n: buckets in turn, in order, from alternating ends of their sorted keys.

    Round r deals to each bucket with more than r rows, so that a pick's
    bucket follows from the sizes of the buckets alone. How many of a bucket's
    earlier picks came from which end gives the row, which is met by its rank from that end.
    """
    a, b = buckets
    order = (F.col(a).asc_nulls_last(), F.col(b).asc_nulls_last())
    sizes = rows.groupBy(a, b).agg(F.count("*").alias("m"))
    turns = sizes.select(a, b, F.explode(F.sequence(F.lit(0), F.least("m", F.lit(n)).cast("int") - 1)).alias("r")).orderBy("r", *order).limit(n)
    picks = turns.withColumn("pick", F.row_number().over(W.orderBy("r", *order)).cast("long"))  # n rows
    odd = F.col("pick") % 2 == 1
    earlier = W.partitionBy(a, b, odd).orderBy("pick")
    picks = picks.select(F.col(a).alias("__a"), F.col(b).alias("__b"), "pick", odd.alias("front"), F.row_number().over(earlier).alias("nth"))
    found = []
    for front, by in ((True, F.asc(key)), (False, F.desc(key))):
        ranks = rows.select(a, b, key).withColumn("nth", F.row_number().over(W.partitionBy(a, b).orderBy(by))).where(F.col("nth") <= n)
        wanted = picks.where(F.col("front") == front)
        found.append(ranks.join(wanted, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b")) & (ranks["nth"] == wanted["nth"])).select("pick", key))
    return found[0].unionByName(found[1])
