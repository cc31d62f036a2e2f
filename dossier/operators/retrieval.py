"""Search over pages and chunks: nearest vectors, BM25, fusion, grep, find, status and reads.

Every limit comes with a total order, so that results repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import around
from ..functions.vectors import literal, squared_distance
from ..schemas import HIT
from ..sources.scratch import drop, written
from .postings import SEPARATORS, Search, in_team, rarity, wanted, weight

# The fusion score, the snippet's length, and the signals in the order that breaks ties.
RANK_OFFSET, AGREEMENT, SNIPPET_CHARS, POOL_FACTOR = 60, 0.01, 400, 3
SIGNALS = ("chunks", "pages", "fts", "images", "assets")
STATUSES = ("complete", "failed", "skipped")
#: Query vectors that are sent to all tasks at once.
QUERY_BLOCK = 1024


def name_contains(column: Column, fragment: str) -> Column:
    """Case-insensitive and literal: % and _ have no meaning."""
    return F.lower(column).contains(fragment.lower())


def nearest(rows: DataFrame, vector: list[float], limit: int, vector_col: str = "vector", id_col: str = "chunk_id", asset_team: str | None = None) -> DataFrame:
    """The rows whose vectors are nearest by Euclidean distance, with ``distance`` (squared). Zero vectors compete like others."""
    rows = in_team(rows, asset_team).where(F.col(vector_col).isNotNull())
    return rows.withColumn("distance", squared_distance(F.col(vector_col), literal(vector))).orderBy("distance", id_col).limit(limit)


def nearest_each(rows: DataFrame, queries: DataFrame, limit: int, vector_col: str = "vector", id_col: str = "chunk_id", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, distance, rank): for each of the queries (query, asked), by distinct names, the rows whose vectors are nearest.

    All rows are read once for each block of queries. Blocks are dealt by a hash of the name and hold about ``block`` vectors, which all tasks get,
    and a task passes on no more than ``limit`` rows for each of them. A null name or vector finds nothing.
    """
    asked, _ = written(queries.where("query IS NOT NULL AND asked IS NOT NULL"), "queries")
    blocks = max(1, -(-asked.count() // block))
    near = rows.where(F.col(vector_col).isNotNull()).select(id_col, F.col(vector_col).alias("__v"))
    out = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        met = near.join(F.broadcast(part.select("query", "asked")), how="cross").select("query", id_col, squared_distance(F.col("__v"), F.col("asked")).alias("distance"))
        best = met.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", id_col))).where(F.col("rank") <= limit)
        out = best if out is None else out.unionByName(best)
    return out


def nearest_images(rows: DataFrame, vector: list[float], limit: int, asset_team: str | None = None) -> DataFrame:
    """The same over image vectors. Of pages, only those with a screenshot take part."""
    if "has_screenshot" in rows.columns:
        rows = rows.where("has_screenshot")
    return nearest(rows, vector, limit, "clip_vector", "page_id" if "asset_id" not in rows.columns else "asset_id", asset_team)


def term_counts(rows: DataFrame, asked: list[str], id_col: str, text_col: str = "text") -> DataFrame:
    """(id, length, tf0, tf1, ...): the number of terms of each text, and how often it has each of some terms.

    Texts are lowered by Spark, as queries and stored terms are. Arrow's string kernels then count in one pass over
    each batch; separators become two spaces, so that neighbours don't share one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.utf8_trim(pc.replace_substring_regex(b.column(1), SEPARATORS, "  "), " ")
            length = pc.if_else(pc.equal(text, ""), 0, pc.add(pc.count_substring(text, "  "), 1))
            spaced = pc.binary_join_element_wise(" ", text, " ", "")
            yield pa.RecordBatch.from_arrays([b.column(0), length.cast(pa.int32()), *(pc.count_substring(spaced, f" {w} ").cast(pa.int32()) for w in asked)], [id_col, "length", *(f"tf{i}" for i in range(len(asked)))])

    tf = "".join(f", tf{i} int" for i in range(len(asked)))
    return rows.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit("")))).mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, length int{tf}")


def bm25(rows: DataFrame, query: str, limit: int, id_col: str = "chunk_id", text_col: str = "text", asset_team: str | None = None) -> DataFrame:
    """(id, score) by BM25 of texts without stored postings.

    Texts are read once: their counts are written, and the statistics over all rows of the team and the scores read these narrow rows. They are
    dropped when the ``limit`` best rows have been taken, which is when this returns.
    """
    asked = wanted(rows.sparkSession, query)
    rows = in_team(rows, asset_team)
    if not asked:
        return rows.select(id_col, F.lit(0.0).alias("score")).limit(0)
    counted, at = written(term_counts(rows, asked, id_col, text_col), "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked)))).first()
    score = sum((rarity(F.lit(stats[f"df{i}"]), F.lit(stats["n"])) * weight(F.col(f"tf{i}"), F.col("length"), F.lit(stats["mean"])) for i in range(len(asked))), F.lit(0.0))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(asked)))
    best = counted.where(some).select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)
    found = rows.sparkSession.createDataFrame(best.collect(), best.schema)
    drop(rows.sparkSession, at)
    return found


def bm25_stored(chunks: DataFrame, table: DataFrame, query: str, limit: int, asset_team: str | None = None) -> DataFrame:
    """(chunk_id, score) by BM25 from a term table without blocks: only the query's terms are read, and of chunks only their lengths."""
    asked = wanted(table.sparkSession, query)
    hits = in_team(table, asset_team).where(F.col("term").isin(asked)).select("term", "chunk_id", "tf", "length")
    stats = in_team(chunks, asset_team).agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).first()
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    each = hits.join(F.broadcast(df), "term").select("chunk_id", (rarity(F.col("df"), F.lit(stats["n"])) * weight(F.col("tf"), F.col("length"), F.lit(stats["mean"]))).alias("s"))
    return each.groupBy("chunk_id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def bm25_blockmax(tables: dict[str, DataFrame], query: str, limit: int, asset_team: str | None = None) -> DataFrame:
    """(chunk_id, score) by BM25 from stored blocks (see ``postings``), of which only those are read that can matter."""
    return Search(tables, query, asset_team).top(limit)


def ranked(hits: DataFrame, signal: str, *order) -> DataFrame:
    """A list of hits (few rows) with their ranks from 1; several rows of one page use up ranks."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("signal", F.lit(signal))


def fuse(lists: list[DataFrame], limit: int, key: str = "page_id") -> DataFrame:
    """One row per page from lists with (page, signal, rank, text): best rank by signal, score, and snippet.

    The score is 1 / (60 + best rank) + 0.01 * sum of 1 / (60 + rank) over signals, so that agreement can beat a
    single better rank. Ties go to the earlier signal and then the better rank.
    """
    together = lists[0].select(key, "signal", "rank", "text")
    for more in lists[1:]:
        together = together.unionByName(more.select(key, "signal", "rank", "text"))
    order = F.array_position(F.array(*(F.lit(s) for s in SIGNALS)), F.col("signal"))
    short = F.substring("text", 1, SNIPPET_CHARS)
    best = together.groupBy(key, "signal").agg(
        F.min("rank").alias("best"), F.min(F.struct(F.length(short).alias("n"), order.alias("at"), F.col("rank").alias("r"), short.alias("s"))).alias("snippet")
    )
    one = best.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "best")))).alias("signals"),
        (F.lit(1.0) / (RANK_OFFSET + F.min("best")) + AGREEMENT * F.sum(F.lit(1.0) / (RANK_OFFSET + F.col("best")))).alias("score"),
        F.min("snippet").alias("snippet"),
        F.min(F.struct(order.alias("at"), F.col("best").alias("rank"))).alias("first"),
    )
    return one.orderBy(F.desc("score"), "first.at", "first.rank", key).limit(limit).select(key, "score", "signals", F.col("snippet.s").alias("text"))


def of_hits(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A list of hits (few rows) with their rows. The keys are taken first, so that texts are read of these only and aren't shuffled where rows are a join."""
    found = hits.collect()  # as many rows as are wanted
    few = hits.sparkSession.createDataFrame(found, hits.schema)
    return F.broadcast(few).join(rows.where(F.col(key).isin([r[key] for r in found])), key)


def search(tables: dict[str, DataFrame], query: str, mode: str, limit: int, embed_text, embed_image=None, asset_team: str | None = None) -> DataFrame:
    """Search in one of six modes; hybrid takes pools of three times the limit from chunks, pages, BM25 and page images."""
    modes = {"hybrid": ("chunks", "pages", "fts", "images"), **{s: (s,) for s in SIGNALS}}
    if mode not in modes:
        raise ValueError(f"unknown search mode {mode!r}")
    pool = limit * POOL_FACTOR if mode == "hybrid" else limit
    lists = []
    for signal in modes[mode]:
        if signal in ("chunks", "pages"):
            key = "chunk_id" if signal == "chunks" else "page_id"
            # vectors are ranked without texts, which only the hits need
            hits = nearest(tables[signal].select(key, "asset_team", "vector"), embed_text(query), pool, "vector", key, asset_team).select(key, "distance")
            lists.append(ranked(of_hits(hits, tables[signal].select(*{key, "page_id"}, "text"), key), signal, "distance", key))
        elif signal == "fts":
            if "postings" in tables:
                hits = bm25_blockmax(tables, query, pool, asset_team)
            elif "terms" in tables:
                hits = bm25_stored(tables["chunks"], tables["terms"], query, pool, asset_team)
            else:
                hits = bm25(tables["chunks"], query, pool, asset_team=asset_team)
            lists.append(ranked(of_hits(hits, tables["chunks"], "chunk_id"), signal, F.desc("score"), "chunk_id"))
        elif embed_image is not None:
            key = "page_id" if signal == "images" else "asset_id"
            hits = nearest_images(tables["pages" if signal == "images" else "assets"], embed_image(query), pool, asset_team)
            text = F.col("text") if signal == "images" else F.lit("")
            lists.append(ranked(hits.withColumn("text", text), signal, "distance", key))
    fused = fuse(lists, limit)
    facts = tables["pages"].select(*HIT)
    return fused.join(facts, "page_id", "left").select(*HIT, "score", "signals", "text").orderBy(F.desc("score"), "page_id")


def grep(pages: DataFrame, pattern: str, regex: bool = False, limit: int = 20, asset_team: str | None = None) -> DataFrame:
    """Pages whose text holds a literal, or matches a Java regular expression, with the first match and what is around it."""
    text = F.col("text")
    rows = in_team(pages, asset_team).where(text.rlike(pattern) if regex else text.contains(pattern))
    match = F.regexp_extract(text, pattern, 0) if regex else F.lit(pattern)
    return rows.withColumn("match", match).withColumn("context", around(text, F.col("match"))).select(*(c for c in HIT if c in pages.columns), "match", "context").orderBy("page_id").limit(limit)


def find_documents(documents: DataFrame, name_query: str | None = None, asset_team: str | None = None, format_gate: str | None = None, limit: int = 25) -> DataFrame:
    rows = in_team(documents, asset_team)
    if name_query:
        rows = rows.where(name_contains(F.col("s3key"), name_query))
    if format_gate:
        rows = rows.where(F.col("format_gate") == format_gate)
    return rows.orderBy("doc_id").limit(limit)


def ledger_filter(ledger: DataFrame, name_query: str | None = None, asset_team: str | None = None, status: str | None = None) -> DataFrame:
    """The team is a case-insensitive prefix of the key here, unlike in searches."""
    if name_query:
        ledger = ledger.where(name_contains(F.col("s3key"), name_query))
    if asset_team:
        ledger = ledger.where(F.lower("s3key").startswith(asset_team.rstrip("/").lower() + "/"))
    return ledger.where(F.col("status") == status) if status else ledger


def will_retry() -> Column:
    return (F.col("status") == "failed") | (F.col("checksum") == "")


def document_status(ledger: DataFrame, name_query: str | None = None, asset_team: str | None = None, status: str | None = None, limit: int = 25) -> DataFrame:
    """One row: matches (at most limit), counts of the fixed statuses over all matches, and the newest update of the whole ledger."""
    rows = ledger_filter(ledger, name_query, asset_team, status)
    first = rows.orderBy("doc_id").limit(limit).withColumn("will_retry", will_retry()).drop("checksum")
    counts = rows.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)).withColumn("total_matches", sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0])))
    newest = ledger.agg(F.max("updated_at").alias("ledger_as_of"))
    listed = first.agg(F.sort_array(F.collect_list(F.struct("doc_id", *(c for c in first.columns if c != "doc_id")))).alias("matches"))
    return listed.crossJoin(counts).crossJoin(newest)  # three single rows


def get_page(pages: DataFrame, page_id: str, screenshots: DataFrame | None = None) -> DataFrame:
    """A page; its image is only read if screenshots are given, and is null where there is none."""
    rows = pages.where(F.col("page_id") == page_id)
    if screenshots is None:
        return rows
    found = screenshots.where((F.col("page_id") == page_id) & (F.length("screenshot") > 0)).select("page_id", "screenshot")
    return rows.join(found, "page_id", "left")


def get_document_pages(pages: DataFrame, doc_id: str) -> DataFrame:
    return pages.where(F.col("doc_id") == doc_id).orderBy("page_num")
