"""Approximate nearest neighbours over randomly rotated one-bit codes.

Each vector is centred, rotated by a random orthonormal matrix and reduced to
the signs of its coordinates, packed to bits, with two correction scalars:
its distance from the centre and the inner product of its direction with its
code. The inner product of a query with a vector is estimated from the packed
bits and these scalars: the query's coordinates are rounded to QUERY_BITS bits, whose planes
meet the codes by AND and population count. An error bound holds with a probability set
by ``epsilon``, and takes in the rounding. A vector is reranked, by its exact distance, unless its lower
bound exceeds the k-th smallest upper bound, or the k-th smallest exact
distance so far. So the bound, not a fixed number of candidates, decides what is looked at.

The index has a row for every vector that takes part: not null, not zero,
without null or non-finite components. Vectors of different lengths aren't compared: each length has an index of its own. Only the
centre is fitted on a bounded sample (``centre_rows``); rows with a null id
are left out. Rows that repeat an id are candidates each for itself, and queries each with a list of its own,
but rows with a query's id are none of its candidates. Ties go to the smaller id. Queries are
the given rows in blocks of about ``query_bytes`` of coordinates, searched one after the other; a block is sent to all
tasks and each task keeps the k nearest of its rows for each query. So the index is read once for each block: vectors are stored
in the width that they come in, and a block is as large as a task's memory allows, not a fixed number of rows. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, stash_path

EPSILON, CENTRE_ROWS = 3.0, 4096
#: Bytes of coordinates, as doubles, of a block of queries; a task holds about four times as much for it.
QUERY_BYTES = 32 << 20
#: Bits to which a query's coordinates are rounded.
QUERY_BITS = 6
#: Candidates and queries whose estimates are held at once.
CHUNK_ROWS, CHUNK_QUERIES, CHUNK_PAIRS = 2048, 256, 65536


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0].astype(np.float64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs packed to 64-bit words, distance from the centre, inner product of direction and code) of each row."""
    y = (x - centre) @ turn
    norm = np.sqrt((y * y).sum(1))
    u = y / np.where(norm > 0, norm, 1)[:, None]
    return packed(u > 0), norm, np.maximum(np.abs(u).sum(1) / np.sqrt(x.shape[1]), 1e-12)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    out = np.packbits(bits, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(np.uint64)


def coordinates(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, list[int]]:
    """(id, v, dim) of the vectors that take part, and the lengths that they have."""
    v = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull())
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fit).withColumn("dim", F.size("v"))
    return rows, sorted(r.dim for r in rows.select("dim").distinct().collect())


def index(rows: DataFrame, dim: int, seed: int = 0, centre_rows: int = CENTRE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(id, v, code, norm, ip) of every row, and the centre that was fitted on a bounded sample."""
    sample = rows.orderBy(F.xxhash64("id")).limit(centre_rows).agg(*(F.avg(F.col("v")[k]) for k in range(dim))).first()
    centre = np.array([x or 0.0 for x in sample])
    turn = rotation(dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, norm, ip = encode(coordinates(b.column(1), dim), centre, turn)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(norm), pa.array(ip)], ["id", "v", "code", "norm", "ip"])

    return rows.select("id", "v").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v {dict(rows.dtypes)['v']}, code binary, norm double, ip double"), centre


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        out += d * d
    return out


class Nearest:
    """The k nearest rows so far for each of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> None:
        self.ids, self.vectors, self.k, self.epsilon = ids, vectors, k, epsilon
        self.turned = (vectors - centre) @ turn
        self.norms = np.sqrt((self.turned**2).sum(1))
        # coordinates as low + step * whole numbers, and the planes of their bits
        low, high = self.turned.min(1, initial=0.0), self.turned.max(1, initial=0.0)
        self.low, self.step = low, np.where(high > low, (high - low) / ((1 << QUERY_BITS) - 1), 1.0)
        whole = np.rint((self.turned - low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [packed((whole >> k) & 1 > 0) for k in range(QUERY_BITS)]
        self.total = (low[:, None] + self.step[:, None] * whole).sum(1)
        self.found = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        self.worst = np.full(len(ids), np.inf)
        self.reranked = 0

    def inner(self, part: slice, code: np.ndarray, dim: int) -> np.ndarray:
        """Estimated inner products of some queries with codes of signs 1 / sqrt(dim)."""
        sums = np.zeros((len(self.low[part]), len(code)), np.float32)
        for k, plane in enumerate(self.planes):
            for word in range(code.shape[1]):
                sums += np.bitwise_count(plane[part, None, word] & code[None, :, word]) * np.float32(1 << k)
        ones = np.bitwise_count(code).sum(1)
        return (2 * (self.low[part, None] * ones[None, :] + self.step[part, None] * sums) - self.total[part, None]) / np.sqrt(dim)

    def see(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, ip: np.ndarray) -> None:
        dim = x.shape[1]
        spread = norm * np.sqrt(np.maximum(0, 1 - ip**2)) / ip * self.epsilon / np.sqrt(max(1, dim - 1))
        for start in range(0, len(self.ids), CHUNK_QUERIES):
            part = slice(start, start + CHUNK_QUERIES)
            inner = self.inner(part, code, dim) * (norm / ip)[None, :]
            near = norm[None, :] ** 2 + self.norms[part, None] ** 2 - 2 * inner
            # what the code leaves open, and what rounding the query can change at most
            rounding = self.step[part, None] * np.sqrt(dim) * (norm / ip)[None, :]
            margin = 2 * spread[None, :] * self.norms[part, None] + rounding + 1e-5 * (norm[None, :] ** 2 + self.norms[part, None] ** 2)
            own = self.ids[part, None] == ids[None, :]
            limit = self.worst[part]
            if len(ids) > self.k:
                upper = np.where(own, np.inf, near + margin)
                limit = np.minimum(limit, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            q, c = np.nonzero((near - margin <= limit[:, None]) & ~own)
            self.rerank(q + start, c, ids, x)

    def rerank(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.reranked += len(q)
        exact = np.concatenate([distances(self.vectors[q[i : i + CHUNK_PAIRS]], x[c[i : i + CHUNK_PAIRS]]) for i in range(0, len(q), CHUNK_PAIRS)] or [np.empty(0)])
        edges = np.searchsorted(q, np.unique(q))
        for first, last in zip(edges, [*edges[1:], len(q)]):
            i = q[first]
            d = np.concatenate([self.found[i][0], exact[first:last]])
            n = np.concatenate([self.found[i][1], ids[c[first:last]]])
            best = np.lexsort((n, d))[: self.k]
            self.found[i] = (d[best], n[best])
            if len(best) == self.k:
                self.worst[i] = d[best[-1]]


def search(indexed: DataFrame, queries: DataFrame, dim: int, centre: np.ndarray, k: int = 10, seed: int = 0, epsilon: float = EPSILON, query_bytes: int = QUERY_BYTES) -> list[DataFrame]:
    """(query_id, rank, vec_id, score): the k nearest rows of each query but itself, by Euclidean distance; a table for each block of queries.

    queries has (id, v). The number of blocks follows the number of queries;
    one block at a time passes the driver and is with the tasks, which bounds what is sent.
    """
    spark = indexed.sparkSession
    blocks = max(1, -(-queries.count() * 8 * dim // query_bytes))
    turn = rotation(dim, seed)
    made = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select(F.col("id").cast("long").alias("id"), "v").orderBy("id", "v").toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast((rows.column("id").to_numpy(), coordinates(rows.column("v"), dim)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            nearest = None
            for whole in batches:
                for start in range(0, whole.num_rows, CHUNK_ROWS):
                    b = whole.slice(start, CHUNK_ROWS)
                    if nearest is None:
                        nearest = Nearest(*sent.value, centre, turn, k, epsilon)
                    x = coordinates(b.column(1), dim)
                    code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(x), -1)
                    nearest.see(b.column(0).to_numpy().astype(np.int64), x, code, b.column(3).to_numpy(), b.column(4).to_numpy())
            if nearest is not None:
                d = [x for x, _ in nearest.found]
                sizes = [len(x) for x in d]
                columns = [np.repeat(np.arange(len(d)), sizes), np.repeat(nearest.ids, sizes), np.concatenate([x for _, x in nearest.found]), np.concatenate(d)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["nth", "query_id", "vec_id", "d2"])

        # nth tells queries of one id apart
        near = indexed.mapInArrow(run, "nth long, query_id long, vec_id long, d2 double")
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "nth").orderBy("d2", "vec_id"))).where(F.col("rank") <= k)
        made.append(stash_path(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score")), "nearest"))
        sent.destroy()
    return [spark.read.parquet(at) for at in made]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): searches all vectors for those whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, dims = valid(vectors, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in dims:
        own = rows.where(F.col("dim") == dim)
        coded, centre = index(own, dim, seed)
        coded_at = stash_path(coded, "codes")
        indexed = spark.read.parquet(coded_at)
        for found in search(indexed, indexed.where(F.col("id") % every == 0), dim, centre, k, seed):
            out = out.unionByName(found)
        drop_path(spark, coded_at)
    return out
