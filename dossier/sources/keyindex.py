"""Which files of a table may hold a key: smallest and largest key of each file, and a Bloom filter in blocks.

A key is in one block of ``BITS`` bits of its file's filter, so that a lookup reads one row for each file of the index, and these rows
are together: the index is sorted by number of blocks and block. A filter has about ``BITS_EACH`` bits for each key (a
file without the key is taken for one in 700 lookups). Keys are compared as strings; null keys aren't indexed.
Everything is built and searched with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "table string, field string, folder string, file string, low string, high string, blocks int, block int, words array<long>"
BITS, BITS_EACH, MARKS = 4096, 16, 5


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks.cast("long")).cast("int")


def _marks(key: Column) -> list[Column]:
    """The bits of a key within its block: 12 bits of a second hash for each."""
    second = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(second, 12 * k).bitwiseAND(F.lit(BITS - 1).cast("long")).cast("int") for k in range(MARKS)]


def _held(words: Column, key: Column) -> Column:
    """Whether all bits of a key are set."""
    out = F.lit(True)
    for at in _marks(key):
        word = F.element_at(words, (F.shiftright(at, 6) + 1))
        out = out & (F.getbit(word, at.bitwiseAND(F.lit(63))) == 1)
    return out


def build(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], folder: str) -> DataFrame:
    """The index of written tables: of each name, the rows as read from its files, and the fields to index."""
    parts = [rows.select(F.lit(name).alias("table"), F.lit(field).alias("field"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(field).cast("string").alias("key")) for name, (rows, fields) in tables.items() for field in fields]
    keys = parts[0]
    for more in parts[1:]:
        keys = keys.union(more)
    keys = keys.where("key IS NOT NULL").distinct()
    by = ["table", "field", "file"]
    size = keys.groupBy(*by).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    # a power of two, so that lookups meet few different numbers
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") * (BITS_EACH / BITS))))).cast("int")
    size = size.select(*by, "low", "high", blocks.alias("blocks"))
    marks = keys.join(size, by).withColumn("block", _block(F.col("key"), F.col("blocks"))).withColumn("mark", F.explode(F.array(*_marks(F.col("key")))))
    whole = [*by, "low", "high", "blocks", "block"]
    bits = marks.groupBy(*whole, F.shiftright("mark", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, mark & 63))").alias("bits"))
    words = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
    return bits.groupBy(*whole).agg(words.alias("m")).select("table", "field", F.lit(folder).alias("folder"), "file", "low", "high", "blocks", "block", dense.alias("words")).sort("table", "field", "blocks", "block", "file")


def files_with(index: DataFrame, table: str, field: str, key: str) -> DataFrame:
    """(folder, file) of the files that may hold a key."""
    value = F.lit(key)
    rows = index.where((F.col("table") == table) & (F.col("field") == field) & (F.col("low") <= value) & (F.col("high") >= value))
    return rows.where((F.col("block") == _block(value, F.col("blocks"))) & _held(F.col("words"), value)).select("folder", "file").distinct()


def files_with_any(index: DataFrame, table: str, field: str, keys: DataFrame) -> DataFrame:
    """(folder, file) of the files that may hold one of many keys (a column ``key``): keys meet the rows of their blocks by equality."""
    rows = index.where((F.col("table") == table) & (F.col("field") == field))
    there = sorted(r.blocks for r in rows.select("blocks").distinct().collect())  # powers of two
    asked = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct().withColumn("blocks", F.explode(F.array(*map(F.lit, there)).cast("array<int>")))
    asked = asked.withColumn("block", _block(F.col("key"), F.col("blocks")))
    return asked.join(rows, ["blocks", "block"]).where((F.col("low") <= F.col("key")) & (F.col("high") >= F.col("key")) & _held(F.col("words"), F.col("key"))).select("folder", "file").distinct()
