"""Near duplicates by MinHash with tensored banding, confirmed on the full shingle sets.

Two collections of ``bands`` bands of ``rows`` minimum hashes are computed for
each document: 2 * bands * rows hashes in all. A table key combines one band
of the first collection with one of the second, so that bands**2 tables of
2 * rows hashes each come from them. With similarity s a pair shares a
table with probability (1 - (1 - s**rows)**bands)**2, which is 0.99993 at 0.8
for ten bands of two hashes, and rises quickly above it.

Documents with equal sets are one class; only classes are compared. In each
table bucket all members are compared with the smallest and the largest id,
and confirmed links join them. In buckets that still hold several components,
members are compared with a few others chosen by chance, in rounds. What is still apart
after that is compared by its rarest shingles, which misses no pair. So every
pair that shares a bucket is compared, already connected, or known to be unlike, without all pairs of a
large group being made.

Before two full sets meet, their sketches do: BITS parities of their hashes,
which differ in no more bits than the sets differ in shingles. So they bound the
similarity from above, and only pairs that this bound leaves are confirmed on
the sets; each choice by chance is among those.

A text's words are split at ASCII white space and lower-cased from A to Z
only. Null and empty texts have an empty set and link with nothing; repeated
rows and equal texts are linked; rows with a null id are left out; other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, map_rows, stash, stash_path
from .components import components_path, extend_path

BANDS, ROWS = 10, 2
#: Rounds in which buckets of several components are searched, and members of each bucket chosen for it.
ROUNDS, PIVOTS = 2, 2
#: Comparisons of each document in a round.
MET = 6
#: Bits of a set's sketch, and the longs that it is folded to where rows are many.
BITS, FOLDED = 1024, 4
#: Words whose hash a task remembers.
REMEMBERED = 60_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of n words."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.hashes = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        s = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            s = _mixed((s ^ h[k : len(h) - n + 1 + k]) * _ODD)
        return np.unique(s)


def _multipliers(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n hash functions over a set."""
    out = np.empty(n, np.uint64)
    for k, m in enumerate(_multipliers(n)):
        x = shingles * m
        out[k] = (x ^ (x >> np.uint64(29))).min() if k % 2 else (x ^ (x >> np.uint64(33))).min()
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BITS parities as longs: a shingle flips one bit. The sketches of two sets differ in at most as many bits as the sets in shingles."""
    bits = np.bincount((_mixed(shingles * _ODD) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def differing(x: list[Column], y: list[Column]) -> Column:
    """The number of bits in which two sketches differ."""
    return functools.reduce(lambda a, b: a + b, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y)))


def may_link(n: Column, n2: Column, bits: Column, percent: int) -> Column:
    """Whether sets of n and n2 shingles that differ in at least so many can have the similarity: their sizes and the difference allow it."""
    return (n * 100 >= n2 * percent) & (n2 * 100 >= n * percent) & ((n + n2 - bits) * (100 + percent) >= (n + n2) * 2 * percent)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that sizes and sketches don't rule out; an id may have several sets."""
    words = BITS // 64
    left = classes.select(F.col("id").alias("a"), F.col("n"), F.col("bits").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y"))
    met = pairs.join(left, "a").join(right, "b")
    bits = differing([F.col("x")[k] for k in range(words)], [F.col("y")[k] for k in range(words)])
    return met.where(may_link(F.col("n"), F.col("n2"), bits, percent)).select("a", "b").distinct()


def met_few(labelled: DataFrame, pivots: DataFrame, classes: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): of the chosen members of other components (key, id2, c2) that a document meets in its buckets (key, id, n, c), at most MET that sizes and sketches don't rule out.

    The chosen ones bring their sketches. A document has those that it meets, at most PIVOTS * BANDS**2, in
    one row, and only what its own sketch leaves becomes a pair.
    """
    words = BITS // 64
    marked = pivots.join(classes.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("bits").alias("y")), "id2")
    like = f"n * 100 >= n2 * {percent} AND n2 * 100 >= n * {percent}"
    met = labelled.join(marked, "key").where(f"c <> c2 AND {like}").groupBy("id").agg(F.collect_set(F.struct("id2", "n2", "y")).alias("met"))

    def open_to(p: Column) -> Column:
        return may_link(F.col("n"), p["n2"], differing([F.col("bits")[k] for k in range(words)], [p["y"][k] for k in range(words)]), percent)

    ranked = F.transform(F.filter("met", open_to), lambda p: F.struct(F.xxhash64(p["id2"], "id", F.lit(turn)).alias("h"), p["id2"].alias("x")))
    few = F.slice(F.array_sort(F.array_distinct(ranked)), 1, MET)
    return met.join(classes.select("id", "n", "bits"), "id").select(F.col("id").alias("a"), F.explode(few).alias("p")).select("a", F.col("p.x").alias("b"))


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_hash, bits, first, second): the set's size, digest and sketch and the two collections' bands (null for an empty set)."""

    def make():
        shingler = Shingler(words)

        def row(key, text):
            s = shingler(text)
            if not len(s):
                return (key, 0, None, None, None, None)
            low = minima(s, 2 * BANDS * ROWS).reshape(2 * BANDS, ROWS)
            band = np.zeros(2 * BANDS, np.uint64)
            for k in range(ROWS):
                band = _mixed((band ^ low[:, k]) * _ODD)
            band = band.view(np.int64)
            return (key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tolist(), band[:BANDS].tolist(), band[BANDS:].tolist())

        return row

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_shingles long, set_hash binary, bits array<long>, first array<long>, second array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id, n): a row for each class and table; a key combines a band of each collection."""
    tables = F.flatten(F.transform("first", lambda a, i: F.transform("second", lambda b, j: F.xxhash64(a, b, i * BANDS + j))))
    return classes.select("id", "n", F.explode(tables).alias("key"))


def set_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, s): the shingle sets of those ids, as the bytes of sorted 64-bit hashes."""

    def make():
        shingler = Shingler(words)
        return lambda key, text: (key, shingler(text).tobytes())

    # always by shuffle, so that the plan is the same at every size; repeated rows meet there and are one set
    return map_rows(docs.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]), make, "id long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def linked(x, y):
        import pandas as pd

        def one(p, q):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(p) + len(q) - len(np.union1d(p, q))
            return 100 * both >= percent * (len(p) + len(q) - both)

        return pd.Series([one(p, q) for p, q in zip(x, y)])

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")).hint("merge"), "b").where(linked("x", "y")).select("a", "b")


def prefix_pairs(open_ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components c that share one of their rarest shingles: no pair with the wanted similarity is missed.

    A set of n shingles has all but ceil(n * percent / 100) - 1 of them in its
    prefix, rarest first; two sets that are alike share a shingle of both
    prefixes. A passage that many documents share is in no prefix unless it
    is nearly all of a document. Pairs that their folded sketches rule out aren't made.
    """

    @F.pandas_udf("array<long>")
    def shingles(x):
        import pandas as pd

        return pd.Series([np.frombuffer(v, np.int64) for v in x])

    @F.pandas_udf("array<long>")
    def folded(x):
        import pandas as pd

        return pd.Series([np.bitwise_xor.reduce(sketch(np.frombuffer(v, np.uint64)).reshape(-1, FOLDED)) for v in x])

    marks = [f"f{i}" for i in range(FOLDED)]
    # an id may have several texts: equal sets count once, others each for itself
    each = sets.join(open_ids, "id").withColumn("k", F.xxhash64("s")).dropDuplicates(["id", "k"])
    own = each.select("id", "c", "k", F.explode(shingles("s")).alias("t"))
    marked = each.withColumn("f", folded("s")).select("id", "k", *(F.col("f")[i].alias(m) for i, m in enumerate(marks)))
    df = own.groupBy("t").agg(F.count("*").alias("df"))
    ranked = own.join(df, "t").groupBy("id", "c", "k").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"), F.count("*").alias("n"))
    prefix = F.slice("ts", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    rare = ranked.join(marked, ["id", "k"]).select("id", "c", "n", *marks, F.posexplode(prefix).alias("at", "x")).where("x.df > 1")
    rare = rare.select("id", "c", (F.col("n") - F.col("at")).alias("rest"), "n", *marks, F.col("x.t").alias("t"))
    other = rare.select(F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("rest").alias("rest2"), F.col("n").alias("n2"), *(F.col(m).alias(m + "y") for m in marks), "t")
    # from the first shingle that both have on, enough must be left for the overlap that the similarity takes
    enough = f"least(rest, rest2) * {100 + percent} >= (n + n2) * {percent}"
    alike = may_link(F.col("n"), F.col("n2"), differing([F.col(m) for m in marks], [F.col(m + "y") for m in marks]), percent)
    return rare.join(other, "t").where(F.expr(f"id < id2 AND c <> c2 AND {enough}") & alike).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per document; kept marks the smallest id of each component.

    Sets of ``words``-word shingles (the whole text, if it has fewer words)
    are linked where 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    made = stash(signatures(docs, words, "id", "text"), "sets")
    of_set = [F.min("id").alias("id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("bits", "first", "second"))]
    classes = stash(made.where("n_shingles > 0").groupBy("set_hash").agg(*of_set), "classes")
    rows = buckets(classes)
    # aggregated before the join: a full bucket is one row per task here, and can be split in the join
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members_at = stash_path(rows.join(shared, "key"), "members")
    members = spark.read.parquet(members_at)
    sets_at = stash_path(set_table(docs, members.select("id").distinct(), words), "shingles")
    sets = spark.read.parquet(sets_at)

    def confirm(pairs: DataFrame) -> str:
        """A table of the links among some pairs (a, b) that are possible."""
        at = stash_path(pairs, "pairs")
        links = stash_path(confirmed(spark.read.parquet(at), sets, percent), "links")
        drop_path(spark, at)
        return links

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    ends = members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.a", "p.b")
    links = confirm(possible(ends.where("a < b").distinct(), classes, percent))
    groups_at = components_path(spark.read.parquet(links))
    drop_path(spark, links)
    for turn in range(ROUNDS):
        # buckets of several components: compare their members with a few chosen by chance
        groups = spark.read.parquet(groups_at)
        labelled = members.join(groups, "id", "left").select("key", "id", "n", F.coalesce("component_id", "id").alias("c"))
        chosen = [F.min_by(F.struct("id", "c"), F.xxhash64("id", "key", F.lit(turn * PIVOTS + k))) for k in range(PIVOTS)]
        pivots = labelled.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m"), F.array(*chosen).alias("ps")).where("c1 < c2 AND m > 2")
        pivots = pivots.select("key", F.explode(F.array_distinct("ps")).alias("p")).select("key", F.col("p.id").alias("id2"), F.col("p.c").alias("c2"))
        links = confirm(met_few(labelled, pivots, classes, percent, turn).select(*ordered("a", "b")).where("a < b").distinct())
        groups_at = extend_path(groups_at, spark.read.parquet(links))
        drop_path(spark, links)
    # what is still apart in some bucket is compared by its rarest shingles: nothing is missed
    groups = spark.read.parquet(groups_at)
    labelled = members.join(groups, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
    open_keys = labelled.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).where("c1 < c2 AND m > 2").select("key")
    open_at = stash_path(labelled.join(open_keys, "key").select("id", "c").distinct(), "open")
    links = confirm(possible(prefix_pairs(spark.read.parquet(open_at), sets, percent), classes, percent))
    members_of = spark.read.parquet(extend_path(groups_at, spark.read.parquet(links)))
    of_class = classes.select("set_hash", "id").join(members_of, "id", "left").select("set_hash", F.coalesce("component_id", "id").alias("component_id"))
    out = made.select("id", "n_shingles", "set_hash").join(of_class, "set_hash", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    for at in (members_at, sets_at, open_at, links):
        drop_path(spark, at)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
