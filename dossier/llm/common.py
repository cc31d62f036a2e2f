"""What several operators share: intermediate tables and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which a query's shuffle files go when it has ended: the written table replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows, and about the bytes, of an Arrow batch that are held as Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20

#: Folders of sessions that name none, and the tables that are still there.
_OWN: dict[str, str] = {}
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session that names none has a temporary one; on a cluster its lack is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="dossier-")
        there = _OWN[app]
    return there.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it again, which cuts its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(stash_path(df, name))


def stash_path(df: DataFrame, name: str, **options: str) -> str:
    """Write df to a table in the shared folder; where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        was = spark.conf.get(CLEANUP)  # with a default given, Spark would not tell its own
    except Exception:  # a Spark that has no such setting
        was = None
    if was is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if was is not None:
            spark.conf.set(CLEANUP, was)
    _WRITTEN.add(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that stash_path wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that are left: those that results read. The results can't be read after that."""
    for path in list(_WRITTEN):
        drop_path(spark, path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and, unless rows are longer, about SLICE_BYTES bytes."""
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_rows(df: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Apply each(*values) -> tuple, or a list of tuples, to rows in Arrow batches.

    ``each`` is made once per task by calling the given factory, so that it can
    hold tables and caches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        work = each()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    made = work(*values)
                    if isinstance(made, list):
                        rows.extend(made)
                    else:
                        rows.append(made)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, kind)


def add_column(df: DataFrame, inputs: list[str], each: Callable, name: str, kind: str) -> DataFrame:
    """All columns of df and ``name`` (in place of a column of that name): each(*inputs) of every row; the others pass as Arrow columns."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    made = _parse_datatype_string(kind)
    kept = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_type(made)
        work = each()
        for batch in batches:
            for part in slices(batch):
                values = [work(*v) for v in zip(*(part.column(c).to_pylist() for c in inputs))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(values, type=out)], [*kept, name])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in kept), StructField(name, made)]))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
