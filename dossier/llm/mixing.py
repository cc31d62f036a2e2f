"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counted in words. The sources, ordered by code point with null
last, have weights that repeat; together they get ``share`` of all words. No
source gets more than ``most`` times its size; what is over is reshared by
weight among the others. This is solved at once: with sources ordered by
their limit for a unit of weight, the first level at which the next source
stays under its limit is the level of all that follow.

Each source's documents fall into BLOCKS blocks by a hash of their id, and
each block into BLOCKS parts. A source's quota is the number of its blocks
that the mix takes: all of them for each whole pass over the source, then blocks in
a permuted order while they fit into what is missing, and one last block (of
those left, the one nearest to what is missing) of which only parts are taken,
in a permuted order, as long as that brings the total nearer to the target.

The quotas are divided among output shards by a splitting tree. At each node
the blocks are split in two halves of equal size by drawing one half at random without replacement,
so that the counts by source have the multivariate hypergeometric
distribution given exact totals. At the leaves each shard draws its number of
blocks from the source's permuted list; no block instance is drawn twice. Rows are then
shuffled within each shard.

The tables of sources and blocks have at most 2 * BLOCKS + 1 rows per source,
whatever the number of documents; documents meet them in a join by source
that sends the table to the tasks while it is small (a checked number of
sources), and shuffles otherwise.

A null text has size 0. Documents of size 0 are taken like others but add no
words. Rows that repeat an id fare alike. An empty table gives an empty mix. Runs repeat
exactly: all draws are hashes of ids, sources and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stash

#: Weights of the sources in order, repeating; the share of all words that the mix has; the most that it takes of a source, in its sizes.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCKS, SHARDS_LOG2 = 256, 3
#: Sources up to which the table of sources (about 12 KB each) is sent to all tasks.
BROADCAST_SOURCES = 2000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    rising = W.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("k", F.row_number().over(rising))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("before", F.sum("limit").over(rising.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("limit"))
        .withColumn("w_from", F.sum("w").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("w_from"))
    )
    level = F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("k"))).over(W.partitionBy())
    return rows.withColumn("at", level).select("source", "source_size", F.least("limit", F.coalesce(F.col("at") * F.col("w"), F.col("limit"))).alias("target"))


def _uniform(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def plan(sized: DataFrame, seed: int = 0, levels: int = SHARDS_LOG2, **options) -> DataFrame:
    """(source, source_size, target, draws, part_block, part_shard, parts) from (source, size, block, part).

    draws maps each block that is taken whole to the shards of its copies;
    parts are those of part_block that go to part_shard.
    """
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = stash(goals.withColumn("missing", F.col("target") - F.col("passes") * F.col("source_size")), "goals")

    def by_source(left: DataFrame, right: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
        return left.join(right.select(F.col("source").alias("__s"), *columns), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")

    permuted = W.partitionBy("source").orderBy(_uniform(seed, "source", "block"), "block")
    ordered = by_source(blocks, goals, "passes", "missing").withColumn("nth", F.row_number().over(permuted)).withColumn("until", F.sum("words").over(permuted))
    ordered = stash(ordered, "blocks")
    # one more block, of which only parts are taken: of those left, the one whose words come nearest to what is still missing
    done = F.coalesce(F.max(F.when(F.col("until") <= F.col("missing"), F.col("until"))).over(W.partitionBy("source")), F.lit(0))
    left = ordered.withColumn("rest", F.col("missing") - done).where("until > missing AND rest > 0")
    edge = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("rest")), "nth", "block", "rest")).alias("e")).select("source", F.col("e.block").alias("part_block"), F.col("e.rest").alias("rest"))
    edge = stash(edge, "edges")
    in_edge = by_source(sized, edge, "part_block", "rest").where("block = part_block")
    by_part = in_edge.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    turn = W.partitionBy("source").orderBy(_uniform(seed + 1, "source", "part"), "part")
    parts = by_part.withColumn("until", F.sum("words").over(turn)).where(F.col("until") - F.col("words") / 2 <= F.col("rest")).groupBy("source").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    # one row for each block that the mix takes, in the order in which shards draw them
    passes = ordered.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).where("pass < passes OR until <= missing AND missing > 0").select("source", "block", "pass", F.lit(False).alias("in_part"))
    taken = passes.unionByName(by_source(edge, parts, "parts").select("source", F.col("part_block").alias("block"), F.lit(-1).alias("pass"), F.lit(True).alias("in_part")))
    taken = taken.withColumn("nth", F.row_number().over(W.partitionBy("source").orderBy(F.col("pass"), _uniform(seed + 2, "source", "block", "pass"), "block")))
    # the splitting tree: half of each node's blocks, drawn without replacement, go left
    taken = stash(taken, "taken")
    node = taken.select("source", "nth", F.lit(0).alias("node"))
    for level in range(levels):
        in_node = W.partitionBy("node")
        drawn = F.row_number().over(in_node.orderBy(_uniform(seed + 3 + level, "source", "nth"), F.col("source").asc_nulls_last(), "nth"))
        node = node.withColumn("n", F.count("*").over(in_node)).withColumn("r", drawn).select("source", "nth", (F.col("node") * 2 + (F.col("r") * 2 > F.col("n") + 1).cast("int")).alias("node"))
    quotas = node.groupBy("source", "node").agg(F.count("*").alias("quota"))
    # each shard draws its quota of the source's list: the next blocks that no other shard has
    ends = quotas.withColumn("end", F.sum("quota").over(W.partitionBy("source").orderBy("node")))
    ends = ends.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("end", "node"))).alias("ends"))
    shard = F.filter("ends", lambda e: e["end"] >= F.col("nth"))[0]["node"].alias("shard")
    drawn = by_source(taken, ends, "ends").select("source", "block", "in_part", shard)
    whole = drawn.where("NOT in_part").groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("block", "shards"))).alias("draws"))
    part = drawn.where("in_part").select("source", F.col("block").alias("part_block"), F.col("shard").alias("part_shard"))
    out = by_source(by_source(by_source(goals.select("source", "source_size", "target"), whole, "draws", how="left"), part, "part_block", "part_shard", how="left"), parts, "parts", how="left")
    return out


def _small(by_source: DataFrame) -> bool:
    return by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", into: str = "mix", **options) -> DataFrame:
    """All rows and columns of docs with ``into`` (in place of a column of that name): a struct of size, source_size, target, shards (one for each copy) and the row's place in a shard's order."""
    size = size_of(F.col(text_col))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    block, part = F.pmod(h, F.lit(BLOCKS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(BLOCKS)).cast("int")
    sized = docs.select(F.col(source_col).alias("source"), size.alias("size"), block.alias("block"), part.alias("part"))
    by_part = stash(sized.groupBy("source", "block", "part").agg(F.sum("size").alias("size")), "parts")
    table = stash(plan(by_part, seed, **options), "mix")
    table = table.select([F.col(c).alias(f"__{c}") for c in table.columns])
    rows = docs.withColumns({"__size": size, "__block": block, "__part": part})
    joined = rows.join(F.broadcast(table) if _small(table) else table, docs[source_col].eqNullSafe(F.col("__source")), "left")
    whole = F.coalesce(F.element_at("__draws", F.col("__block")), F.array().cast("array<int>"))
    in_part = (F.col("__block") == F.col("__part_block")) & F.array_contains("__parts", F.col("__part"))
    shards = F.concat(whole, F.when(F.coalesce(in_part, F.lit(False)), F.array("__part_shard")).otherwise(F.array().cast("array<int>")))
    facts = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), shards.alias("shards"), F.xxhash64(F.lit(seed + 99), F.col(id_col)).alias("place"))
    return joined.withColumn("__mix", facts).select(*(docs[c] for c in docs.columns if c != into), F.col("__mix").alias(into))


def copies(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """The mix itself: a row for each copy with its ``shard`` (in place of a column of that name), shuffled within the shards of each partition."""
    columns = [c for c in mixed.columns if c not in (into, "shard")]
    rows = mixed.select(*columns, F.col(into)["place"].alias("__place"), F.posexplode(F.col(into)["shards"]).alias("__copy", "__shard"))
    return rows.sortWithinPartitions("__shard", F.xxhash64("__place", "__copy")).select(*columns, F.col("__shard").alias("shard"))
