"""What a graph is built from: texts of parsed documents, and one status for each document of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

OK, PRIOR, NO_OUTPUT, FAILED = "ok", "skipped-prior-ok", "no-parse-output", "failed"


def file_data(content: Column) -> Column:
    """A file as analysts take it: its content and encoding."""
    return F.struct(content.alias("content"), F.lit("utf-8").alias("encoding"))


def view_text(key: Column, kind: Column, pages: Column, fields: Column, field_pages: Column) -> Column:
    """The text of a view: an extraction's fields and the pages that they cite as JSON, or its pages, each under its source; null without either."""
    head = lambda *rest: F.concat(F.lit("<!-- source: "), key, *(F.lit(r) if isinstance(r, str) else r for r in rest), F.lit(" -->\n"))
    body = F.to_json(F.struct(fields.alias("fields"), F.coalesce(field_pages, F.create_map().cast("map<string,array<int>>")).alias("field_page_citations")))
    paged = F.array_join(F.transform(pages, lambda p: F.concat(head(" | page: ", p["page"].cast("string")), F.coalesce(p["markdown"], F.lit("")))), "\n\n")
    return F.when(kind == "extraction", F.when(fields.isNotNull(), F.concat(head(" | structured extraction"), body))).when(F.size(pages) > 0, paged)


def graph_texts(views: DataFrame) -> DataFrame:
    """(key, kind, text, error) of normalised views; ``error`` tells why a view couldn't be read, if they carry it."""
    error = F.col("error") if "error" in views.columns else F.lit(None).cast("string")
    return views.select("key", "kind", view_text(F.col("key"), F.col("kind"), F.col("pages"), F.col("fields"), F.col("field_pages")).alias("text"), error.alias("error"))


def run_status(rows: DataFrame, texts: DataFrame, done: DataFrame, without_output: DataFrame | None = None) -> DataFrame:
    """(key, status, kind, chars, error): one row for each document of a run.

    A document that an earlier run finished (``done``) is skipped, one without text has no
    parse output, and so have the rows ``without_output``; one with an error failed. The texts of those that are ok are to be added.
    """
    known = done.select("key").distinct().withColumn("__done", F.lit(True))
    joined = rows.select("key").join(texts, "key", "left").join(known, "key", "left")
    status = F.when(F.col("__done"), PRIOR).when(F.col("error").isNotNull(), FAILED).when(is_blank(F.col("text")), NO_OUTPUT).otherwise(OK)
    taken = F.col("status") == OK
    out = joined.withColumn("status", status).select(
        "key",
        "status",
        F.when(taken | (F.col("status") == NO_OUTPUT), F.coalesce("kind", F.lit(""))).otherwise("").alias("kind"),
        F.when(taken, F.length("text")).otherwise(0).cast("long").alias("chars"),
        F.when(F.col("status") == FAILED, F.substring("error", 1, 200)).otherwise("").alias("error"),
    )
    if without_output is None:
        return out
    none = without_output.select("key", F.lit(NO_OUTPUT).alias("status"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("chars"), F.lit("").alias("error"))
    return out.unionByName(none)


def seeded_lines(views: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, line): what an analyst is told of each seeded document."""
    rows = views.select("key", "kind", "page_count").join(manifest.select("key", "entry_type"), "key", "left")
    entry = F.coalesce(F.nullif("entry_type", F.lit("")), F.lit("unknown"))
    return rows.select("key", F.concat(F.lit("- "), "key", F.lit(" | entry_type: "), entry, F.lit(" | kind: "), "kind", F.lit(" | pages: "), F.col("page_count").cast("string")).alias("line"))


def verified_by_class(verified: DataFrame) -> DataFrame:
    return verified.groupBy("cls").agg(F.count("*").alias("n"))
