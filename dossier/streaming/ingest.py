"""Continuous ingest: new files of a folder in micro-batches, each committed to the store by the batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ingest
from ..sources.files import relative
from ..sources.scratch import drop, written
from ..sources.store import Store


def stream_ingest(spark: SparkSession, root: str, store: Store, checkpoint: str, now: Callable[[], str], embed_text: Callable[[Column], Column], files_per_batch: int = 1000):
    """Starts a query that takes what has arrived and stops. Batches that run again change nothing: the ledger knows their checksums."""
    files = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(root)
    )

    def batch(df: DataFrame, _: int) -> None:
        rows, at = written(df.withColumn("key", relative(F.col("path"), root)), "arrived")
        try:
            listing = rows.select("key", F.split("key", "/")[0].alias("asset_team"), F.lit(None).cast("string").alias("etag"))
            ingest(store, listing, rows.select("key", "content"), now(), embed_text)
        finally:
            drop(spark, at)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame, key: str, at: str, watermark: str = "1 day") -> DataFrame:
    """The newest row of each key of an event stream, as an update stream; works on batches too."""
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in events.columns if c != key)), at).alias("r")).select(key, "r.*")
