"""The entity graph: export rows, label repair, tags, closure and traversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

NAME_CHARS = 500
#: Properties that node rows hold in columns of their own.
OWN_COLUMNS = ("type", "label", "name", "text")


def relationship(properties: Column, label: Column) -> Column:
    """The name in the properties, if they are a JSON object with one that isn't empty; else the label."""
    found = F.try_variant_get(F.try_parse_json(properties), "$.relationship_name", "string")
    return F.coalesce(F.nullif(found, F.lit("")), label)


def fallback_label(properties: Column, native: Column, table_label: Column) -> Column:
    return F.coalesce(F.nullif(F.try_variant_get(F.try_parse_json(properties), "$.relationship_name", "string"), F.lit("")), F.nullif(native, F.lit("")), table_label)


def node_rows(nodes: DataFrame) -> DataFrame:
    """(id, type, name, properties) from (id, props map): all four own columns leave the properties, also those that weren't used."""
    p = F.col("props")
    first = lambda *keys: F.coalesce(*(p[k] for k in keys), F.lit(""))
    rest = F.map_filter(p, lambda k, v: ~k.isin(*OWN_COLUMNS))
    return nodes.select(F.col("id").cast("string").alias("id"), first("type", "label").alias("type"), F.substring(first("name", "text"), 1, NAME_CHARS).alias("name"), F.to_json(rest).alias("properties"))


def edge_rows(edges: DataFrame) -> DataFrame:
    """(source, target, label, properties) from (source, target, label, props map or null)."""
    props = F.coalesce("props", F.create_map().cast("map<string,string>"))
    label = F.coalesce(F.nullif(props["relationship_name"], F.lit("")), F.col("label"))
    return edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), label.alias("label"), F.to_json(props).alias("properties"))


def label_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count("*").alias("n"))


def label_agreement(edges: DataFrame) -> DataFrame:
    """How many labels agree with the relationship in the properties."""
    r = relationship(F.col("properties"), F.col("label"))
    return edges.agg(F.count("*").alias("n"), F.count_if(F.col("label") == r).alias("agree"))


def vendor_wells(nodes: DataFrame, edges: DataFrame, vendor_type: str, well_type: str) -> DataFrame:
    """Names of valid vendors and the wells that an edge links them with."""
    valid = F.try_variant_get(F.try_parse_json("properties"), "$.ontology_valid", "boolean")
    ok = nodes.where(valid)
    v = ok.where(F.col("type") == vendor_type).select(F.col("id").alias("source"), F.col("name").alias("vendor"))
    w = ok.where(F.col("type") == well_type).select(F.col("id").alias("target"), F.col("name").alias("well"))
    return edges.join(v, "source").join(w, "target").select("vendor", "label", "well")


def closure(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, depth): everything that each child is under, with the length of the shortest way; a cycle is under itself.

    After n rounds all shortest ways of up to 2^n steps are known. A longer one, of up to twice as many, begins with one of exactly 2^n,
    so that a round joins only these with the others, and there is nothing more to find when none is so long: a chain of n takes about log2(n) rounds.
    """
    spark = parents.sparkSession
    ways = parents.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("ancestor")).where("child IS NOT NULL AND ancestor IS NOT NULL").distinct()
    ways, at = written(ways.withColumn("depth", F.lit(1)), "closure")
    steps = 1
    while ways.where(F.col("depth") == steps).limit(1).count():
        onward = ways.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = ways.where(F.col("depth") == steps).join(onward, "ancestor").select("child", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        was = at
        ways, at = written(ways.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        drop(spark, was)
        steps *= 2
    return ways


def tags(payload: Column, prefix: str) -> Column:
    """Distinct tags of that prefix in a nested payload's text, in the order in which they stand; empty ones don't count."""
    return F.array_distinct(F.regexp_extract_all(payload, F.lit(prefix + r'([^"\s,\]\}]+)'), F.lit(1)))


def provenance(edges: DataFrame, prefix: str = "s3key:") -> DataFrame:
    """(source, target, label, key): each edge with the documents that its properties name."""
    return edges.select("source", "target", "label", F.explode(tags(F.col("properties"), prefix)).alias("key"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """(start, id, hop): what is reached from the given ids over edges in either direction."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()
    reached = start.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, hops + 1):
        frontier = frontier.join(both, frontier["id"] == both["a"]).select("start", F.col("b").alias("id"), F.lit(hop).alias("hop")).distinct()
        reached = reached.unionByName(frontier)
    return reached.groupBy("start", "id").agg(F.min("hop").alias("hop"))
