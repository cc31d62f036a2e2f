"""Centroid clustering over dictionaries of subvectors.

Vectors of whole numbers are cut into blocks of ``width`` dimensions. The vectors of a chunk (at most ``CHUNK_ROWS`` rows of a
partition) are stored as each block's distinct subvectors and, for each vector, their numbers, from which the vectors can be had back:
nothing is lost. In a round, the exact squared distances of these subvectors from the centroids' blocks are computed once,
a vector's distance is the sum of the entries that its numbers name, and a cluster's sum is the subvectors times how often the cluster has
them. A dictionary belongs to its chunk, so that it is bounded however many distinct subvectors the table has, and no row is
shuffled: a round reads the chunks and each task hands on one row for each centroid.

Kept are vectors with ``dim`` finite components; rows with null or other vectors have no row in the result. Rows that repeat an id
are vectors each for itself; a null id has a row, but never starts a centroid. With fewer vectors than centroids there are as many centroids as
vectors. An empty table gives an empty result. Components of 2^22 / scale or more are an error. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stash_path
from .lattice import finite_rows, floors, squared, whole

DIM, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
WIDTH, CHUNK_ROWS = 2, 16384


def distinct(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the number of each row's): column by column, so that no hash decides."""
    number = np.zeros(len(block), np.int64)
    for column in block.T:
        values, at = np.unique(column, return_inverse=True)
        _, first, number = np.unique(number * len(values) + at, return_index=True, return_inverse=True)
    return block[first], number


def encode(x: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The subvectors of each block of dimensions, and the numbers of each row's."""
    pairs = [distinct(x[:, at : at + width]) for at in range(0, x.shape[1], width)]
    return [words for words, _ in pairs], [number.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32) for words, number in pairs]


def assign(words: list[np.ndarray], numbers: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector; ties go to the smaller number."""
    total, at = np.zeros((len(numbers[0]), len(centroids)), np.int64), 0
    for w, n in zip(words, numbers):
        total += squared(w, centroids[:, at : at + w.shape[1]])[n]
        at += w.shape[1]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def cluster_sums(words: list[np.ndarray], numbers: list[np.ndarray], best: np.ndarray, k: int) -> np.ndarray:
    """The sum of each cluster's vectors: its subvectors times how often it has them."""
    return np.concatenate([np.bincount(best * len(w) + n, minlength=k * len(w)).reshape(k, len(w)) @ w for w, n in zip(words, numbers)], axis=1)


def chunks(rows: DataFrame, dim: int, scale: int, width: int, chunk_rows: int) -> DataFrame:
    """(ids, words, numbers): a row for each chunk of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            ids, x = pa.chunked_array([i for i, _ in held]).combine_chunks(), np.concatenate([x for _, x in held])
            words, numbers = encode(x, width)
            columns = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([[a.astype(kind).tobytes() for a in part]], pa.list_(pa.binary())) for part, kind in ((words, "<i4"), (numbers, "<u4")))]
            return pa.RecordBatch.from_arrays(columns, ["ids", "words", "numbers"])

        for b in batches:
            for start in range(0, b.num_rows, chunk_rows):
                part = b.slice(start, chunk_rows)
                if held and sum(len(x) for _, x in held) + part.num_rows > chunk_rows:
                    yield made()
                    held.clear()
                held.append((part.column(0), whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim), scale)))
        if held:
            yield made()

    return rows.select("id", "v").mapInArrow(run, "ids array<long>, words array<binary>, numbers array<binary>")


def _read(batches: Iterator[pa.RecordBatch], dim: int, width: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """Each chunk as (ids, words, numbers)."""
    widths = [min(width, dim - at) for at in range(0, dim, width)]
    for b in batches:
        for i in range(b.num_rows):
            words = [np.frombuffer(x, "<i4").astype(np.int64).reshape(-1, w) for x, w in zip(b.column(1)[i].as_py(), widths)]
            yield b.column(0)[i].values, words, [np.frombuffer(x, "<u4") for x in b.column(2)[i].as_py()]


@dataclass
class Clusters:
    #: (vec_id, cluster, distance)
    members: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, width: int = WIDTH, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> Clusters:
    """Lloyd's rounds from the k vectors whose ids, after ``salt``, have the smallest sha256."""
    rows = finite_rows(vectors, id_col, vector_col).where(F.size("v") == dim)
    first = rows.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)).orderBy("h", "v").limit(k).collect()
    centroids = whole(np.array([r.v for r in first], np.float64).reshape(-1, dim), scale)
    if not first:
        return Clusters(vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids)
    at = stash_path(chunks(rows, dim, scale, width, chunk_rows), "subvectors")
    stored = vectors.sparkSession.read.parquet(at)
    for _ in range(rounds):

        def gather(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(now), np.int64), np.zeros((len(now), dim), np.int64)
            for _, words, numbers in _read(batches, dim, width):
                best, _ = assign(words, numbers, now)
                n += np.bincount(best, minlength=len(now))
                sums += cluster_sums(words, numbers, best, len(now))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *(pa.array(sums[some, d]) for d in range(dim))], ["cluster", "n", *(f"s{d}" for d in range(dim))])

        each = stored.mapInArrow(gather, "cluster int, n long, " + ", ".join(f"s{d} long" for d in range(dim)))
        centroids = centroids.copy()
        for r in each.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dim))).collect():
            centroids[r.cluster] = floors(np.array(r[2:], dtype=object), r.n)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, numbers in _read(batches, dim, width):
            best, distance = assign(words, numbers, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    members = stash_path(stored.mapInArrow(settle, "vec_id long, cluster int, distance long"), "members")
    drop_path(vectors.sparkSession, at)
    return Clusters(vectors.sparkSession.read.parquet(members), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """The members with cluster_inertia, inertia and the hash of their centroid's components. The tables that are joined have a row for each centroid."""
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    spark = found.members.sparkSession
    sums = {r.cluster: r.d for r in found.members.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    each = spark.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.members.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
