"""Exact substring deduplication with a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes that also starts earlier (in a smaller id,
or earlier in the same text) is found, and each byte that such a string
covers is removed; texts are judged as given.

The suffix arrays are sparse: of all suffixes, those at anchors (see
``anchors``) are kept. Equal strings of ``length`` bytes have equal anchors at
equal distances, so no match is lost. An entry holds a hash of the first bytes
of its suffix (entries are ordered by it, which brings equal beginnings
together as alphabetic order would), 96 bits of hash of the context, that is of all
windows that have this anchor, and its place. Entries live in buckets by their
beginning, each a row of sorted arrays.

Batches of about equal size arrive in the order of ids, more of them the larger
the corpus. A new batch's suffix array is merge-scanned against all levels of the family; then it merges with
the last level while that is as large as it, as a binary counter carries. So levels have 1, 2, 4, ... batches,
and an entry is rewritten a logarithmic number of times. The scan finds:

* entries whose context occurs earlier: all their windows repeat;
* entries whose beginning occurs with another context: some windows may repeat.
  The contexts of these few are cut out of their texts at the end, and their windows,
  told apart by 96 bits of hash, are joined over the corpus, which settles them.

Entries that repeat within a task are settled there, and of each beginning that
has several contexts in a task only a witness is sent to where that beginning is
gathered. So no task gathers all of a common passage's occurrences.

Null and short texts lose nothing; very long ones are treated whole. Rows with a null id are returned whole and
repeat nothing. Equal rows count as one document and get equal results; of
rows that share an id but not a text, each loses the bytes at the places that
repeat in any of them. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors
from .common import drop_path, map_rows, slices, stash_path

LENGTH = 100
#: Batches of a small corpus, and the bytes from which each doubling adds one.
BATCHES, BATCH_BYTES = 4, 1 << 30
#: Bytes of text for which there is a bucket, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, 64
#: Entries, and windows, that a task settles together.
BUFFER = 400_000
_MIX = np.int64(-7046029254386353131)
#: Kinds of packed rows: entries for a bucket, entries that repeat, entries whose windows are to be tested.
ENTRIES, REPEATS, OPEN = 0, 1, 2
PACKED = "kind int, bucket long, key binary, ctx binary, more binary, doc binary, place binary, flags binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
#: Flags of entries: of many contexts in a task; a witness of such; its windows are to be tested already.
SHARED, WITNESS, OPENED = 1, 2, 4


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b >> np.int64(31))) * _MIX + b
    return x ^ (x >> np.int64(29))


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers with equal bytes of all together: zeros compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def rising(x: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return planes(np.concatenate([x[:1], x[1:] - x[:-1]]))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data))


def _runs(changed: np.ndarray) -> np.ndarray:
    """The number of the run that each element is in."""
    return np.cumsum(changed) - 1


def _change(*columns: np.ndarray) -> np.ndarray:
    """Whether an element differs from the one before it in any column."""
    out = np.zeros(len(columns[0]), bool)
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    out[:1] = True
    return out


def _place_key(key: np.ndarray, ctx: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """By what entries meet: their beginning, but entries with SHARED, whose contexts are many, by their context too."""
    return np.where(flags & SHARED > 0, _mix(key, ctx), key)


def _pack(kind: int, bucket: np.ndarray, key, ctx, more, doc, place, flags) -> list[tuple]:
    """Rows of PACKED, one for each bucket."""
    o = np.lexsort((key, bucket))
    bucket, key, ctx, more, doc, place, flags = (x[o] for x in (bucket, key, ctx, more, doc, place, flags))
    cuts = [*np.flatnonzero(_change(bucket)).tolist(), len(o)]
    return [(kind, int(bucket[i]), rising(key[i:j]), ctx[i:j].tobytes(), more[i:j].tobytes(), planes(doc[i:j]), planes(place[i:j]), flags[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])] if len(o) else []


def _places(kind: int, bucket: int, doc: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Rows of PACKED that only say where."""
    return [(kind, bucket, b"", b"", b"", planes(doc), planes(place), b"")] if len(doc) else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], NAMES)


def suffix_array(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """PACKED rows of a batch (id, text): its sampled suffixes by bucket, and those that repeat within a task."""

    def settle(key, ctx, more, doc, place) -> pa.RecordBatch:
        o = np.lexsort((place, doc, more, ctx, key))
        key, ctx, more, doc, place = (x[o] for x in (key, ctx, more, doc, place))
        new_key = _change(key)
        new_ctx = new_key | _change(ctx, more)
        first = np.flatnonzero(new_ctx)[_runs(new_ctx)]
        # rows that repeat an id and all else are one
        again = ~new_ctx & ((doc != doc[first]) | (place != place[first]))
        rows = _places(REPEATS, 0, doc[again], place[again])
        several = np.bincount(_runs(new_key), new_ctx)[_runs(new_key)] > 1
        witness = np.flatnonzero(new_key & several)
        kept = np.concatenate([np.flatnonzero(new_ctx), witness])
        flags = np.where(several[kept], np.uint8(SHARED), np.uint8(0))
        flags[len(kept) - len(witness) :] = WITNESS
        key, ctx, more, doc, place = (x[kept] for x in (key, ctx, more, doc, place))
        bucket = (_place_key(key, ctx, flags).view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        return _batch(rows + _pack(ENTRIES, bucket, key, ctx, more, doc, place, flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        n = 0
        for whole in batches:
            for b in slices(whole):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    data = (text or "").encode("utf-8")
                    key, a, i, j = anchors(data, length)
                    if not len(a):
                        continue
                    # a context is its bytes and where in them the anchor is
                    digests = b"".join([xxhash.xxh3_128_digest(data[x : y + length], z - x) for x, y, z in zip(i.tolist(), j.tolist(), a.tolist())])
                    ctx = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    for column, x in zip(held, (key, ctx[:, 0], ctx[:, 1].astype(np.uint32), np.full(len(a), doc, np.int64), (i << 12) | (j - i))):
                        column.append(x)
                    n += len(a)
                    if n >= BUFFER:
                        yield settle(*map(np.concatenate, held))
                        held, n = [[], [], [], [], []], 0
        if n:
            yield settle(*map(np.concatenate, held))

    return docs.select("id", "text").mapInArrow(run, PACKED)


def scan(keep: bool):
    """Merges the arrays of one bucket: rows of PACKED with ``tag`` (0 the new batch, 1 levels that merge with it, 2 levels that stay)."""

    def run(rows: pa.Table) -> pa.Table:
        get = lambda c, read: [read(x) for x in rows.column(c).to_pylist()]
        keys = get("key", risen)
        tag = np.repeat(rows.column("tag").to_numpy(), [len(k) for k in keys])
        key = np.concatenate(keys)
        ctx = np.concatenate(get("ctx", lambda x: np.frombuffer(x, np.int64)))
        more = np.concatenate(get("more", lambda x: np.frombuffer(x, np.uint32)))
        doc, place = np.concatenate(get("doc", numbers)), np.concatenate(get("place", numbers))
        flags = np.concatenate(get("flags", lambda x: np.frombuffer(x, np.uint8)))
        at = _place_key(key, ctx, flags)
        witness = flags & WITNESS > 0
        o = np.lexsort((place, doc, witness, more, ctx, key, at))
        tag, key, ctx, more, doc, place, flags, at, witness = (x[o] for x in (tag, key, ctx, more, doc, place, flags, at, witness))
        new_key = _change(at, key)
        new_ctx = new_key | _change(ctx, more)
        new = new_ctx | _change(witness)
        first = np.flatnonzero(new)[_runs(new)]
        once = new | (doc != doc[first]) | (place != place[first])  # rows that repeat an id and all else are one
        later = ~new & once
        group = _runs(new_key)
        several = (np.bincount(group, new_ctx) > 1) | (np.bincount(group, witness) > 0)
        several = several[group]
        shared = flags & SHARED > 0
        again = later & ~witness
        opened = once & ~again & ~witness & (several | shared) & ((tag == 0) | (flags & (SHARED | OPENED) == 0))
        made = _places(REPEATS, 0, doc[again & (tag == 0)], place[again & (tag == 0)]) + _places(OPEN, 0, doc[opened], place[opened])
        if keep:
            level = (tag < 2) & once & ~later
            bucket = np.full(int(level.sum()), rows.column("bucket")[0].as_py(), np.int64)
            flags = flags | np.where(several & ~shared & ~witness, np.uint8(OPENED), np.uint8(0))
            made += _pack(ENTRIES, bucket, key[level], ctx[level], more[level], doc[level], place[level], flags[level])
        return pa.Table.from_batches([_batch(made)])

    return run


class Family:
    """Levels of suffix arrays (how many batches each has, and where), newest last, and what their scans have found so far."""

    def __init__(self, spark: SparkSession, buckets: int, length: int = LENGTH) -> None:
        self.spark, self.buckets, self.length = spark, buckets, length
        self.levels: list[tuple[int, str]] = []
        self.found: list[str] = []
        #: Of each batch, how many levels it merged with, and how many it was scanned against that stayed.
        self.log: list[tuple[int, int]] = []

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """Scan a batch (id, text) against all levels and carry it into the family. After the last one no index is kept."""
        array_at = stash_path(suffix_array(batch, self.length, self.buckets), "array")
        array = self.spark.read.schema(PACKED).parquet(array_at)
        rows = array.where(F.col("kind") == ENTRIES).withColumn("tag", F.lit(0))
        size, merging = 1, []
        while self.levels and self.levels[-1][0] == size:
            n, path = self.levels.pop()
            merging.append(path)
            size += n
        for tag, paths in ((1, merging), (2, [path for _, path in self.levels])):
            for path in paths:
                rows = rows.unionByName(self.spark.read.schema(PACKED).parquet(path).where(F.col("kind") == ENTRIES).withColumn("tag", F.lit(tag)))
        self.log.append((len(merging), len(self.levels)))
        out_at = stash_path(rows.groupBy("bucket").applyInArrow(scan(not last), PACKED), "scan")
        out = self.spark.read.schema(PACKED).parquet(out_at)
        where = out.where(F.col("kind") != ENTRIES).unionByName(array.where(F.col("kind") == REPEATS))
        self.found.append(stash_path(where.select("kind", "doc", "place"), "found"))
        if not last:
            self.levels.append((size, out_at))
        for old in (array_at, *([out_at] if last else []), *merging):
            drop_path(self.spark, old)

    def close(self) -> None:
        for _, path in self.levels:
            drop_path(self.spark, path)
        self.levels = []

    def places(self, kind: int) -> DataFrame:
        """(doc, place) of what the scans found."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers(doc)), pa.array(numbers(place))], ["doc", "place"])

        return self.spark.read.parquet(*self.found).where(F.col("kind") == kind).select("doc", "place").mapInArrow(run, "doc long, place long")


_TABLE = np.random.default_rng(7).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)


def window_hashes(data: bytes, length: int, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every window, from sums of a random polynomial; kinds are independent."""
    x = _TABLE[kind][np.frombuffer(data, np.uint8)] * _powers(_P[kind], len(data) - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    h = (sums[length:] - sums[:-length]) * _powers(pow(_P[kind], -1, 1 << 64), len(data) - length)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(doc, at, bytes): the bytes that the windows at those places cover; runs of windows that touch are one."""

    def make():
        def row(doc, text, places):
            data, spans = (text or "").encode("utf-8"), []
            for p in sorted(places):
                a, b = p >> 12, (p >> 12) + (p & 4095) + length
                if b > len(data):
                    continue  # of another text of that id
                if spans and a <= spans[-1][1] - length + 1:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            return [(doc, a, data[a:b]) for a, b in spans]

        return row

    by_doc = places.groupBy(F.col("doc").alias("id")).agg(F.collect_set("place").alias("places"))
    return map_rows(docs.join(by_doc.hint("merge"), "id").select("id", "text", "places"), make, "doc long, at long, bytes binary")


WINDOWS = "bucket long, hash binary, more binary, doc binary, at binary, n binary"
WINDOW_NAMES = [c.split()[0] for c in WINDOWS.split(", ")]


def repeated_windows(found: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc, a, b): the spans of windows of contexts that start earlier too."""

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(6)], WINDOW_NAMES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of windows that repeat within a task, the first goes to its bucket, and the others are known: as runs, in rows without hashes."""
        held: list[list] = [[], [], [], []]
        n = 0

        def flush():
            h, more, doc, at = map(np.concatenate, held)
            o = np.lexsort((at, doc, h))
            h, more, doc, at = h[o], more[o], doc[o], at[o]
            first = _change(h, more)
            top = np.flatnonzero(first)[_runs(first)]
            again = ~first & ((doc != doc[top]) | (at != at[top]))
            rd, ra = doc[again], at[again]
            o = np.lexsort((ra, rd))
            rd, ra = rd[o], ra[o]
            begins = np.flatnonzero(_change(rd, ra - np.arange(len(ra))))
            runs = np.diff(np.append(begins, len(rd)))
            rows = [(int(rd[0] % buckets), b"", b"", planes(rd[begins]), planes(ra[begins]), planes(runs))] if len(rd) else []
            h, more, doc, at = h[first], more[first], doc[first], at[first]
            bucket = h.view(np.uint64) % np.uint64(buckets)
            o = np.argsort(bucket, kind="stable")
            h, more, doc, at, bucket = h[o], more[o], doc[o], at[o], bucket[o]
            cuts = [*np.flatnonzero(_change(bucket)).tolist(), len(o)]
            rows += [(int(bucket[i]), rising(h[i:j]), more[i:j].tobytes(), planes(doc[i:j]), planes(at[i:j]), b"") for i, j in zip(cuts, cuts[1:])]
            return rows_of(rows)

        for whole in batches:
            for b in slices(whole):
                for doc, at, data in zip(*(c.to_pylist() for c in b.columns)):
                    h = window_hashes(data, length)
                    for column, x in zip(held, (h, window_hashes(data, length, 1).astype(np.uint32), np.full(len(h), doc, np.int64), np.arange(at, at + len(h)))):
                        column.append(x)
                    n += len(h)
                    if n >= 2 * BUFFER:
                        yield flush()
                        held, n = [[], [], [], []], 0
        if n:
            yield flush()

    def settle(rows: pa.Table) -> pa.Table:
        get = lambda c, read: [read(x) for x in rows.column(c).to_pylist()]
        hashes, docs, ats = get("hash", risen), get("doc", numbers), get("at", numbers)
        whole = [k for k, h in enumerate(hashes) if len(h)]
        out = [(docs[k], ats[k], n) for k, n in enumerate(get("n", numbers)) if len(n)]
        if whole:
            h, doc, at = (np.concatenate([x[k] for k in whole]) for x in (hashes, docs, ats))
            more = np.concatenate(get("more", lambda x: np.frombuffer(x, np.uint32)))
            o = np.lexsort((at, doc, more, h))
            h, more, doc, at = h[o], more[o], doc[o], at[o]
            first = _change(h, more)
            top = np.flatnonzero(first)[_runs(first)]
            again = ~first & ((doc != doc[top]) | (at != at[top]))
            out.append((doc[again], at[again], np.ones(int(again.sum()), np.int64)))
        doc, a, n = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return pa.table({"doc": doc, "a": a, "b": a + n - 1 + length})

    return found.mapInArrow(windows, WINDOWS).groupBy("bucket").applyInArrow(settle, "doc long, a long, b long")


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, runs removed) for spans that may overlap."""
    data = text.encode("utf-8")
    out, gone, runs, end = [], 0, 0, 0
    for a, b in sorted((a, min(b, len(data))) for a, b in spans if a < len(data)):
        if a > end or not runs:
            out.append(data[end:a])
            runs += 1
            gone += b - a
            end = b
        elif b > end:
            gone += b - end
            end = b
    out.append(data[end:])
    return b"".join(out), gone, runs


def batches_for(size: int) -> int:
    """How many batches a corpus of so many bytes arrives in."""
    return BATCHES + max(0, math.ceil(math.log2(max(1, size) / BATCH_BYTES)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int | None = None) -> tuple[DataFrame, list[str], Family]:
    """(doc, spans) for distinct documents (id, text): the byte spans (start, end) that repeat, which may overlap; the tables that this reads; and the family, whose log tells what was scanned."""
    spark = docs.sparkSession
    parts = 256
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("id", [k / parts for k in range(1, parts)], 10000).alias("ids")).first()
    batches = batches or batches_for(facts.bytes or 0)
    cuts = sorted({facts.ids[parts * k // batches - 1] for k in range(1, batches)}) if facts.ids else []
    buckets = max(BUCKETS, -(-(facts.bytes or 0) // BUCKET_BYTES))
    family = Family(spark, buckets, length)
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("id") > low)
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        family.add(batch, last=high is None)
    family.close()
    contexts_at = stash_path(contexts(docs, family.places(OPEN), length), "contexts")
    windows_at = stash_path(repeated_windows(spark.read.parquet(contexts_at), length, buckets), "spans")
    drop_path(spark, contexts_at)
    place = F.col("place")
    by_row = family.places(REPEATS).select("doc", F.shiftright(place, 12).alias("a"), (F.shiftright(place, 12) + place.bitwiseAND(F.lit(4095)) + length).alias("b"))
    spans_at = stash_path(by_row.union(spark.read.parquet(windows_at)).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "cuts")
    for at in (windows_at, *family.found):
        drop_path(spark, at)
    return spark.read.parquet(spans_at), [spans_at], family


def dedupe(docs: DataFrame, length: int = LENGTH, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the bytes that are left of each text."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs.where("id IS NOT NULL"), length, batches)[0].withColumnRenamed("doc", "id")

    def make():
        def row(key, text, found):
            kept, gone, runs = cut(text or "", [(x["a"], x["b"]) for x in found or ()])
            return key, len((text or "").encode("utf-8")), gone, runs, kept

        return row

    return map_rows(docs.join(spans.hint("merge"), "id", "left").select("id", "text", "spans"), make, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary")
