"""Incremental ingest: what of a listing is new, parsing it, and committing rows with the ledger.

One pass is one commit: listing and ledger are joined, what is to do is parsed in
Arrow batches, and new rows replace old ones of the same documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TEXT_MAX_CHARS, TEXT_MAX_CHUNKS, chunks, is_blank, page_id_for
from ..functions.vectors import zero
from ..schemas import CLIP_DIMS
from ..sources.files import with_identity
from ..sources.scratch import drop, written
from ..sources.store import Conflict, Store, Version
from .manifest import batch_cap
from .postings import blocks, term_table, terms

DONE = ("complete", "skipped")
#: How often a pass starts anew when another writer has changed its documents meanwhile.
ATTEMPTS = 3
FIGURES = "array<struct<page_num: int, kind: string, image: binary>>"


def needs_ingest(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """The listing with ``todo``: false where the ledger has the same checksum, not empty, as complete or skipped."""
    known = ledger.select("doc_id", F.col("status").alias("__s"), F.col("checksum").alias("__c"))
    same = F.col("__s").isin(*DONE) & (F.col("__c") != "") & (F.col("__c") == F.col("checksum"))
    return listing.join(known, "doc_id", "left").withColumn("todo", ~F.coalesce(same, F.lit(False))).drop("__s", "__c")


def upsert_unchanged(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose upsert changes nothing: complete with the same checksum (skipped ones are parsed again)."""
    return listing.join(ledger.where("status = 'complete'").select("doc_id", "checksum"), ["doc_id", "checksum"], "left_semi")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != key)), order).alias("r")).select(key, "r.*")


def text_outcome(content: Column, most: int = TEXT_MAX_CHARS) -> Column:
    """(ok, text, truncated) of a text file: UTF-8 with replacements, capped; blank is a failure."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.struct((~is_blank(text)).alias("ok"), F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


def content_checksum(content: Column) -> Column:
    """What tells contents apart; empty for contents that couldn't be fetched."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


@dataclass
class Report:
    requested: int
    complete: int
    unchanged: int
    skipped: int
    failed: int
    reconciled: int
    stopped_early: bool
    #: (key, reason) of this pass's failures, as rows that are read when wanted.
    failures: DataFrame | None = None


def ingest(store: Store, listing: DataFrame, contents: DataFrame, now: str, embed_text: Callable[[Column], Column], max_new: int | None = None, keep_last_good: bool = False, parse_binary: Callable[[DataFrame], DataFrame] | None = None, embed_image: Callable[[Column], Column] | None = None) -> Report:
    """One pass over a listing (key, asset_team, etag or null) with contents (key, content); missing contents are failed fetches.

    Skips by format are recorded without reading. A failed document loses the rows that it had, unless keep_last_good is
    set, and has an empty checksum, so that the next pass tries again. parse_binary turns rows (key, doc_id, content) of other gates into
    (doc_id, ok, retriable, reason, pages array<struct<page_num, text, screenshot, width, height>>), and perhaps figures
    array<struct<page_num, kind, image>>, which become assets; without it they fail. embed_image gives the vectors of screenshots and
    figures; without it, and for pages without a screenshot, they are zero. Blank pages have zero text vectors, which compete like others.
    If another writer has changed the same documents since the ledger was read, nothing of the pass is kept and it starts anew, as their ledger rows may
    leave nothing to do; the last such conflict is raised.
    """
    reconciled = store.reconcile()
    for attempt in range(ATTEMPTS):
        try:
            report = _pass(store, store.current(), listing, contents, now, embed_text, max_new, keep_last_good, parse_binary, embed_image)
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
        else:
            return replace(report, reconciled=reconciled)
    raise AssertionError


def _pass(store: Store, base: Version, listing: DataFrame, contents: DataFrame, now: str, embed_text: Callable[[Column], Column], max_new: int | None, keep_last_good: bool, parse_binary: Callable[[DataFrame], DataFrame] | None, embed_image: Callable[[Column], Column] | None) -> Report:
    rows = with_identity(listing)
    if "ordinal" not in rows.columns:
        rows = rows.withColumn("ordinal", F.col("key"))
    tag = F.when(F.coalesce("etag", F.lit("")) != "", F.concat(F.lit("etag:"), "etag")).otherwise(F.lit(""))
    ledger = store.table("ledger", base)
    by_tag = needs_ingest(rows.withColumn("checksum", tag), ledger)
    todo = by_tag.where("todo").drop("todo")
    skip = F.col("gate").startswith("skip:")
    read = todo.where(~skip).join(contents, "key", "left")
    read = read.withColumn("checksum", F.when(F.col("checksum") != "", F.col("checksum")).otherwise(content_checksum(F.col("content"))))
    fresh = needs_ingest(read, ledger).where("todo").drop("todo")
    every = fresh.unionByName(todo.where(skip).withColumn("content", F.lit(None).cast("binary")))
    if max_new is not None:
        n_before = every.count()
        every = batch_cap(every.withColumn("is_new", F.lit(True)), max_new, "is_new", "ordinal").drop("is_new")
    out = text_outcome(F.col("content"))
    parsed = every.withColumn("o", F.when(F.col("gate") == "text", out))
    none = F.array().cast("array<struct<page_num:int,text:string,screenshot:binary,width:int,height:int>>")
    page = F.array(F.struct(F.lit(1).alias("page_num"), F.col("o.text").alias("text"), F.lit(None).cast("binary").alias("screenshot"), F.lit(0).alias("width"), F.lit(0).alias("height")))
    reason = (
        F.when(skip, F.substring("gate", 6, 1000))
        .when(F.col("content").isNull(), "fetch failed")
        .when((F.col("gate") == "text") & ~F.col("o.ok"), "no text content")
    )
    state = F.when(skip, "skipped").when(F.col("content").isNull(), "failed").when((F.col("gate") == "text") & F.col("o.ok"), "complete").otherwise("failed")
    parsed = parsed.withColumn("status", state).withColumn("reason", reason).withColumn("pages", F.when((F.col("gate") == "text") & F.col("o.ok"), page).otherwise(none))
    if parse_binary is not None:
        made = parse_binary(parsed.where(F.col("gate").isin("pdf", "image") & F.col("content").isNotNull()).select("key", "doc_id", "content"))
        figures = F.col("figures") if "figures" in made.columns else F.lit(None)
        made = made.select("doc_id", "ok", "retriable", F.col("reason").alias("r"), F.col("pages").alias("p"), figures.cast(FIGURES).alias("figures"))
        parsed = parsed.join(made, "doc_id", "left")
        by_parser = F.when(F.col("ok"), "complete").when(~F.col("retriable"), "skipped").otherwise("failed")
        parsed = parsed.withColumn("status", F.when(F.col("ok").isNotNull(), by_parser).otherwise(F.col("status"))).withColumn("reason", F.when(F.col("ok").isNotNull(), F.col("r")).otherwise(F.col("reason"))).withColumn("pages", F.when(F.coalesce("ok", F.lit(False)), F.col("p")).otherwise(F.col("pages")))
    else:
        parsed = parsed.withColumn("reason", F.when(F.col("gate").isin("pdf", "image") & F.col("content").isNotNull(), "no parser").otherwise(F.col("reason")))
    if "figures" not in parsed.columns:
        parsed = parsed.withColumn("figures", F.lit(None).cast(FIGURES))
    parsed = parsed.withColumn("checksum", F.when(F.col("status") == "failed", "").otherwise(F.col("checksum"))).drop("content", "o")
    # parsed once, and read again by each table that is written
    parsed, parsed_at = written(parsed, "parsed")
    try:
        flat = parsed.select("doc_id", F.col("key").alias("s3key"), "asset_team", "gate", F.explode("pages").alias("p"))
        vector = lambda text: F.when(is_blank(text), F.transform(embed_text(text), lambda _: F.lit(0.0).cast("float"))).otherwise(embed_text(text))
        image = lambda content: embed_image(content) if embed_image else zero(CLIP_DIMS)
        common = ("doc_id", "s3key", "asset_team")
        pid = page_id_for(F.col("doc_id"), F.col("p.page_num"))
        shot = F.coalesce(F.length("p.screenshot") > 0, F.lit(False))
        pages = flat.select(pid.alias("page_id"), *common, F.col("p.text").alias("text"), F.col("p.page_num").alias("page_num"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), vector(F.col("p.text")).alias("vector"), F.when(shot, image(F.col("p.screenshot"))).otherwise(zero(CLIP_DIMS)).alias("clip_vector"), shot.alias("has_screenshot"))
        pieces = F.when(F.col("gate") == "text", chunks(F.col("p.text"), TEXT_MAX_CHUNKS)).otherwise(chunks(F.col("p.text")))
        chunk = flat.select(pid.alias("page_id"), *common, F.col("p.page_num").alias("page_num"), F.posexplode(pieces).alias("i", "text"))
        new_chunks = chunk.select(F.concat("page_id", F.lit(":c"), "i").alias("chunk_id"), "page_id", *common, "text", "page_num", F.size(terms(F.col("text"))).alias("n_terms"), embed_text(F.col("text")).alias("vector"))
        drawn = parsed.select("doc_id", F.col("key").alias("s3key"), "asset_team", F.posexplode("figures").alias("i", "f"))
        fid = page_id_for(F.col("doc_id"), F.col("f.page_num"))
        assets = drawn.select(F.concat(fid, F.lit(":a"), "i").alias("asset_id"), fid.alias("page_id"), *common, F.col("f.kind").alias("kind"), F.col("f.page_num").alias("page_num"), F.col("f.image").alias("image"), image(F.col("f.image")).alias("clip_vector"))
        sums = new_chunks.agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).first()
        n_chunks = new_chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
        facts = parsed.join(n_chunks, "doc_id", "left")
        new_ledger = facts.select("doc_id", F.col("key").alias("s3key"), "checksum", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.size("pages").alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce(F.size("figures"), F.lit(0)).alias("asset_count"), F.lit(now).alias("updated_at"))
        new = {
            "documents": parsed.where("status = 'complete'").select(*("doc_id",), F.col("key").alias("s3key"), "asset_team", F.col("gate").alias("format_gate"), F.size("pages").alias("page_count")),
            "pages": pages,
            "chunks": new_chunks,
            "postings": blocks(term_table(new_chunks, "chunk_id", "doc_id", "asset_team"), size=(sums.n, sums.mean)),
            "assets": assets,
            "screenshots": flat.where(shot).select(pid.alias("page_id"), "doc_id", F.col("p.screenshot").alias("screenshot")),
            "ledger": new_ledger,
        }
        touched = parsed.where("status <> 'failed'") if keep_last_good else parsed
        if keep_last_good:
            new["ledger"] = new_ledger.where("status <> 'failed'").unionByName(new_ledger.where("status = 'failed'").join(ledger, "doc_id", "left_anti"))
        tally = {r.status: r["count"] for r in parsed.groupBy("status").count().collect()}
        requested = rows.count()
        # only documents that are there have rows to delete
        store.replace(touched.select("doc_id").join(ledger, "doc_id", "left_semi"), new, base=base)
    finally:
        drop(store.spark, parsed_at)
    worked = sum(tally.values())
    stopped = max_new is not None and worked < n_before
    unchanged = requested - (n_before if max_new is not None else worked)
    return Report(requested, tally.get("complete", 0), unchanged, tally.get("skipped", 0), tally.get("failed", 0), 0, stopped, store.table("ledger").where((F.col("status") == "failed") & (F.col("updated_at") == now)).select(F.col("s3key").alias("key"), "reason"))


def dry_run(listing: DataFrame) -> DataFrame:
    """(gate, n): what a pass would do by format; all skips are one."""
    gate = F.when(F.col("gate").startswith("skip:"), "skip").otherwise(F.col("gate"))
    return with_identity(listing).groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))
