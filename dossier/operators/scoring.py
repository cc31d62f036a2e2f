"""Retrieval quality of ranked pages against questions with expected pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_K = 5
# The signals that count as a hit of a question's modality.
MODALITY_SIGNALS = {
    "text": ["chunks", "pages", "fts"],
    "text_native": ["chunks", "pages", "fts"],
    "table": ["chunks", "pages", "fts", "images", "assets"],
    "figure": ["images", "assets"],
}


def score_questions(questions: DataFrame, hits: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(id, modality, any_page_hit, page_coverage, modality_hit) from questions (id, modality, expected_pages) and hits (id, rank, s3key, page_num, signals)."""
    expected = questions.select("id", "modality", F.explode_outer(F.array_distinct("expected_pages")).alias("e")).select("id", "modality", "e.s3key", F.col("e.page").alias("page_num"))
    top = hits.where(F.col("rank") <= top_k).select("id", "s3key", "page_num", F.map_keys("signals").alias("has"))
    allowed = F.lit(None).cast("array<string>")
    for modality, signals in MODALITY_SIGNALS.items():
        allowed = F.when(F.col("modality") == modality, F.array(*(F.lit(s) for s in signals))).otherwise(allowed)
    found = expected.join(top, ["id", "s3key", "page_num"], "left")
    by_page = found.groupBy("id", "modality", "s3key", "page_num").agg(
        F.count("has").alias("n"), F.coalesce(F.bool_or(F.arrays_overlap("has", allowed)), F.lit(False)).alias("of_modality")
    )
    pages = F.count("s3key")
    return by_page.groupBy("id", "modality").agg(
        F.bool_or(F.col("n") > 0).alias("any_page_hit"),
        F.when(pages > 0, F.count_if(F.col("n") > 0) / pages).otherwise(0.0).alias("page_coverage"),
        F.bool_or("of_modality").alias("modality_hit"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """Means by modality and over all (modality null), unrounded; one row of zeros without questions."""
    means = [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_at_{TOP_K}") for c in ("any_page_hit", "page_coverage", "modality_hit")]
    return scores.rollup("modality").agg(F.count("*").alias("n"), *means)
