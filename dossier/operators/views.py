"""Parsed documents: raw JSON of several shapes to one view, and views to text and to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip, virtual_dir
from ..sources.scratch import written


def _variant_array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def normalize(raw: DataFrame, key_col: str = "key", json_col: str = "json") -> DataFrame:
    """(key, kind, pages, fields, field_pages, page_count) from JSON: a cached view, a parse run's chunks, an extraction, or none of them (an empty view).

    A page without a number takes its place among all chunks, usable or not.
    """
    v = F.try_parse_json(F.col(json_col))
    text = lambda x, p: F.try_variant_get(x, p, "string")
    kind, cached, chunk = text(v, "$.kind"), _variant_array(v, "$.pages"), _variant_array(v, "$.output.chunks")
    is_view = cached.isNotNull() & kind.isin("markdown", "extraction")
    view_pages = F.transform(cached, lambda p: F.struct(F.try_variant_get(p, "$.page", "int").alias("page"), text(p, "$.markdown").alias("markdown")))
    is_text = lambda c: F.schema_of_variant(F.try_variant_get(c, "$.content", "variant")) == "STRING"
    numbered = F.transform(chunk, lambda c, i: F.struct(F.coalesce(F.try_variant_get(c, "$.metadata.pageRange.start", "int"), i + 1).alias("page"), text(c, "$.content").alias("markdown"), is_text(c).alias("ok")))
    run_pages = F.transform(F.filter(numbered, lambda p: p["ok"]), lambda p: F.struct(p["page"].alias("page"), p["markdown"].alias("markdown")))
    fields = F.try_variant_get(v, "$.output.value", "map<string,variant>")
    meta = F.try_variant_get(v, "$.output.metadata", "map<string,variant>")
    cites = F.transform_values(
        F.coalesce(meta, F.create_map().cast("map<string,variant>")),
        lambda _, m: F.filter(F.transform(F.coalesce(_variant_array(m, "$.citations"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$.page.number", "int")), lambda n: n.isNotNull()),
    )
    field_pages = F.map_filter(cites, lambda _, p: F.size(p) > 0)
    last = F.coalesce(F.array_max(F.flatten(F.map_values(field_pages))), F.lit(0))
    none = F.array().cast("array<struct<page:int,markdown:string>>")
    is_run, is_fields = ~is_view & chunk.isNotNull(), ~is_view & chunk.isNull() & fields.isNotNull()
    is_view = F.coalesce(is_view, F.lit(False))
    shape = F.when(is_view, "view").when(F.coalesce(is_run, chunk.isNotNull()), "run").when(F.coalesce(is_fields, fields.isNotNull()), "fields").otherwise("none")
    out = raw.select(F.col(key_col).alias("key"), shape.alias("shape"), kind.alias("k"), view_pages.alias("vp"), run_pages.alias("rp"), fields.alias("f"), field_pages.alias("fp"), last.alias("last"),
                     F.coalesce(F.try_variant_get(v, "$.page_count", "int"), F.try_variant_get(v, "$.pageCount", "int"), F.size(cached)).alias("vc"))
    extraction = F.col("shape") == "fields"
    return out.select(
        "key",
        F.when(F.col("shape") == "view", F.col("k")).when(extraction, "extraction").otherwise("markdown").alias("kind"),
        F.coalesce(F.when(F.col("shape") == "view", F.col("vp")).when(F.col("shape") == "run", F.col("rp")), none).alias("pages"),
        F.when(extraction, F.col("f")).alias("fields"),
        F.when(extraction, F.col("fp")).alias("field_pages"),
        F.when(F.col("shape") == "view", F.col("vc")).when(F.col("shape") == "run", F.size("rp")).when(extraction, F.col("last")).otherwise(0).alias("page_count"),
    )


def choose_source(manifest_views: DataFrame, cache_views: DataFrame) -> DataFrame:
    """The manifest's view of each key, else the cache's; ``source`` tells which."""
    ranked = manifest_views.withColumn("source", F.lit("manifest")).unionByName(cache_views.withColumn("source", F.lit("cache")))
    return ranked.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.when(F.col("source") == "manifest", 0).otherwise(1)))).where("nth = 1").drop("nth")


def read_views(asked: DataFrame, manifest_views: DataFrame, cache_views: DataFrame, parse: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], None]) -> DataFrame:
    """The view of each asked key: the manifest's, else the cache's, else one that is parsed now and kept for later runs; ``source`` tells which.

    parse turns (key) into views of the same columns; keep appends them to the cache. What has been parsed is
    written once, so that the result and the cache hold the same.
    """
    keys = asked.select("key").distinct()
    found = choose_source(manifest_views.join(keys, "key", "left_semi"), cache_views.join(keys, "key", "left_semi"))
    fresh, _ = written(parse(keys.join(found.select("key"), "key", "left_anti")).select(*manifest_views.columns), "fresh")
    keep(fresh)
    return found.unionByName(fresh.withColumn("source", F.lit("parsed")))


def serialize(pages: DataFrame, key: str, page_col: str = "page", text_col: str = "markdown") -> DataFrame:
    """(key, text): a document's pages that aren't blank, in order, each under a mark with its number. Pages of one document meet in one row."""
    rows = pages.where(~is_blank(F.col(text_col)))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("n"), strip(F.col(text_col)).alias("t")))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("[page "), p["n"].cast("string"), F.lit("]\n"), p["t"])), "\n\n")
    return gathered.select(key, text.alias("text"))


def render_files(pages: DataFrame, key_col: str = "key", page_col: str = "page", text_col: str = "markdown") -> DataFrame:
    """(path, content): one virtual file per page, with its source in the header."""
    path = F.concat(virtual_dir(F.col(key_col)), F.format_string("/page-%04d.md", F.col(page_col)))
    header = F.concat(F.lit("<!-- source: "), F.col(key_col), F.lit(" | page: "), F.col(page_col).cast("string"), F.lit(" -->\n\n"))
    return pages.select(path.alias("path"), F.concat(header, F.col(text_col)).alias("content"))


def parse_answer(text: Column) -> Column:
    """The JSON object within a reply, between the first brace and the last; null without one."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
