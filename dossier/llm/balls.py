"""Vector code compression: codebooks of subvectors by ball k-means.

Vectors of whole numbers are cut into ``parts`` equal consecutive parts, each of which has a codebook of its own. An entry and the
parts that it holds are a ball, whose radius is the largest distance of one of them. In a round after the first:

* an entry's neighbours are the entries within twice its radius: no other can be as near to one of its parts;
* a part within half the distance of the nearest neighbour is in the stable core and keeps its entry, and so does a whole ball
  that hasn't moved and none of whose neighbours has;
* outside of it, neighbours are taken in the order of their distances: a part in the ring between the halves of two successive
  ones only meets those up to the first, in exact arithmetic. Ties go to the smaller number, so equality stays in the ring.

Radii are taken with the last round's distances plus how far the entry has moved since, so that a round is one pass: rows and their
new codes are written, and beside them each task writes a row of sums, counts and radius for each entry. The driver holds the codebooks only.

Vectors of each length have codebooks of their own; a length that can't be cut evenly is cut as evenly as can be. Rows whose vectors are null or hold
null or non-finite components are dropped; rows that repeat an id are coded each for itself, and a null id comes last in the choice
of first entries. With fewer vectors than entries there are as many entries as vectors. An empty table gives an
empty result. Components of 2^22 / scale or more are an error. Other columns but the label are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stash_path
from .lattice import finite_rows, floors, squared, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a task codes at once, and neighbours of a ring that are compared at once.
CHUNK_ROWS, RING = 32768, 16


def cuts(dim: int, parts: int) -> list[slice]:
    return [slice(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


@dataclass
class Balls:
    """A part's entries, and for each of them its neighbours, nearest first, with their squared distances; empty before the first round."""

    entries: np.ndarray
    near: list[np.ndarray] | None = None
    gaps: list[np.ndarray] | None = None
    #: Balls that nothing can have left or joined since the last round.
    still: np.ndarray | None = None

    def moved(self, sums: dict[int, tuple[int, int, np.ndarray]]) -> Balls:
        """The next round's balls from (count, squared radius, sum) of each entry that has parts."""
        new = self.entries.copy()
        for j, (n, _, total) in sums.items():
            new[j] = floors(total, n)
        shift = ((new - self.entries) ** 2).sum(1)
        between = squared(new, new)
        near, gaps, still = [], [], np.zeros(len(new), bool)
        for j in range(len(new)):
            far = sums[j][1] if j in sums else 0
            reach = math.ceil((math.sqrt(far) + math.sqrt(int(shift[j]))) ** 2 * (1 + 1e-9)) + 1
            found = np.flatnonzero(between[j] <= 4 * reach)
            found = found[found != j]
            order = found[np.argsort(between[j, found], kind="stable")]
            near.append(order)
            gaps.append(between[j, order])
            still[j] = not shift[j] and not shift[order].any()
        return Balls(new, near, gaps, still)

    def assign(self, x: np.ndarray, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each part, and how many distances of other entries were computed."""
        if self.near is None or code is None:
            d = squared(x, self.entries)
            best = d.argmin(1)
            return best, d[np.arange(len(x)), best], d.size
        best, least, met = code.astype(np.int64), ((x - self.entries[code]) ** 2).sum(1), 0
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for j in np.flatnonzero(np.diff(edges)):
            if self.still[j] or not len(self.gaps[j]):
                continue
            own = order[edges[j] : edges[j + 1]]
            rings = np.searchsorted(self.gaps[j], 4 * least[own], side="right")
            for start in range(0, int(rings.max()), RING):
                some = own[rings > start]
                others = self.near[j][start : start + RING]
                d = squared(x[some], self.entries[others])
                met += d.size
                low = d.min(1)
                first = np.where(d == low[:, None], others[None, :], len(self.entries)).min(1)
                better = (low < least[some]) | ((low == least[some]) & (first < best[some]))
                best[some[better]], least[some[better]] = first[better], low[better]
        return best, least, met


class Gathered:
    """Counts, squared radii and sums of the entries of each part, over a task's rows."""

    def __init__(self, books: list[Balls]) -> None:
        self.n = [np.zeros(len(b.entries), np.int64) for b in books]
        self.far = [np.zeros(len(b.entries), np.int64) for b in books]
        self.sums = [np.zeros(b.entries.shape, np.int64) for b in books]

    def see(self, part: int, x: np.ndarray, code: np.ndarray, least: np.ndarray) -> None:
        self.n[part] += np.bincount(code, minlength=len(self.n[part]))
        np.maximum.at(self.far[part], code, least)
        np.add.at(self.sums[part], code, x)

    def rows(self) -> list[tuple]:
        return [(p, int(j), int(n[j]), int(self.far[p][j]), self.sums[p][j].tolist()) for p, n in enumerate(self.n) for j in np.flatnonzero(n)]


def coded(rows: DataFrame, dim: int, books: list[Balls], scale: int, first: bool, last: bool) -> DataFrame:
    """One round's pass: (stat, id, label, v, code, error) of each row, and with stat (part, entry, n, far, sums) of each task."""
    label = dict(rows.dtypes)["label"]
    where = cuts(dim, len(books))
    schema = f"stat boolean, id long, label {label}, v binary, code binary, error long, part int, entry int, n long, far long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(books)

        def made(b: pa.RecordBatch) -> pa.RecordBatch:
            if first:
                x = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim), scale)
                was = None
            else:
                x = np.frombuffer(b"".join(b.column("v").to_pylist()), "<i4").astype(np.int64).reshape(b.num_rows, dim)
                was = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, (book, at) in enumerate(zip(books, where)):
                part = np.ascontiguousarray(x[:, at])
                best, least, _ = book.assign(part, None if was is None else was[:, p])
                codes[:, p] = best
                error += least
                if not last:
                    gathered.see(p, part, best, least)
            v = pa.nulls(len(x), pa.binary()) if last else pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), bool)), b.column("id"), b.column("label"), v, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), *none], names)

        names = ["stat", "id", "label", "v", "code", "error", "part", "entry", "n", "far", "sums"]
        kind = None
        for b in batches:
            kind = b.schema.field("label").type
            for start in range(0, b.num_rows, CHUNK_ROWS):
                yield made(b.slice(start, CHUNK_ROWS))
        if kind is not None and not last and (rest := gathered.rows()):
            n = len(rest)
            part, entry, count, far, sums = zip(*rest)
            none = [pa.nulls(n, t) for t in (pa.int64(), kind, pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), *none, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count), pa.array(far), pa.array(sums, pa.list_(pa.int64()))], names)

    return rows.mapInArrow(run, schema)


def gather(stats: DataFrame, widths: list[int]) -> list[dict[int, tuple[int, int, np.ndarray]]]:
    """(count, squared radius, sum) of each part's entries over all tasks."""
    most = max(widths)
    each = stats.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(most)))
    out: list[dict[int, tuple[int, int, np.ndarray]]] = [{} for _ in widths]
    for r in each.collect():  # a row for each entry
        out[r.part][r.entry] = (r.n, r.far, np.array(r[4 : 4 + widths[r.part]], dtype=object))
    return out


def digest(books: list[Balls]) -> str:
    """sha256 of all entries' components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code binary of a byte for each part, error, codebooks_sha256) of every vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: up to 256 entries")
    spark = vectors.sparkSession
    rows = finite_rows(vectors, id_col, vector_col, label_col, "label")
    out = spark.createDataFrame([], f"vec_id long, label {dict(rows.dtypes)['label']}, code binary, error long, codebooks_sha256 string")
    for dim in sorted(r.dim for r in rows.select(F.size("v").alias("dim")).distinct().collect()):
        own = rows.where(F.size("v") == dim).select("id", "label", "v")
        start = own.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        x = whole(np.array([r.v for r in start], np.float64).reshape(len(start), dim), scale)
        books = [Balls(np.ascontiguousarray(x[:, at])) for at in cuts(dim, parts)]
        widths = [b.entries.shape[1] for b in books]
        at = None
        for n in range(rounds + 1):
            source = own if at is None else spark.read.parquet(at).where("NOT stat").select("id", "label", "v", "code")
            was, at = at, stash_path(coded(source, dim, books, scale, n == 0, n == rounds), "codes")
            if was:
                drop_path(spark, was)
            if n < rounds:
                books = [b.moved(s) for b, s in zip(books, gather(spark.read.parquet(at).where("stat"), widths))]
        made = spark.read.parquet(at).where("NOT stat").select(F.col("id").alias("vec_id"), "label", "code", "error")
        out = out.unionByName(made.withColumn("codebooks_sha256", F.lit(digest(books))))
    return out
