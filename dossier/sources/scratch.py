"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of a local session that has none; on a cluster its lack is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="dossier-")
        there = _OWN[app]
    return there.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table that is written once, and where it is."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
