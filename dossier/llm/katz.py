"""A Katz backoff language model over words, counted, normalised and evaluated by Spark.

Counts: words are counted first. The most frequent ones, at most CODED, get small numbers, known to all
tasks, which only makes keys shorter; other words are hashes of 63 bits. Then each task counts pairs of neighbours in buffers, and the
counts meet in buckets as sorted arrays: pairs after a word without number by that word, others by the pair.
All pairs of a word without number are thus in one bucket, and there are at most a CODED-th or so of all tokens of them.
Words and pairs are discounted by Good-Turing up to LIMIT, and pairs that occur fewer than ``least`` times are left
to backoff (none with a least of 1), with counts of counts over the whole corpus (absolute discounting where these
give no factor within 0 and 1). The mass that words leave is the probability of an unknown word.

    P(w | v) = discounted share of the pair, if it was seen, else alpha(v) * P(w)

alpha(v) is exact: what the seen pairs leave, over what their words leave in the
distribution of words. A word that leaves nothing is scaled down, so that every text has a
probability. Texts begin with a mark that is never counted as a token and end with
one that is.

Evaluation rewrites the sum over a text as backoff everywhere, plus a correction
where a pair was seen. Tasks send each distinct pair of a buffer once, with
the documents that hold it, to the bucket that has it; the buckets
send back sums by document. Each word but the end is the first of one pair, and the bucket of a word without number has all pairs
after it, so that it knows the word's count and alpha too: words are asked for with their pairs, and no table has them.
Words with a number, and pairs of such words with at least a
HOT-th of all counts (at most 2 * HOT), are kept out of this: they are sent to all tasks. Questions are
asked for one of PARTS parts of the documents after the other, which bounds the room that they take.

Null texts are empty texts: they hold only the end. Rows that repeat are scored each for itself;
a null id is never held out. Without any training text all words are unknown, with probability 1. Other columns are dropped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_path, slices, stash, stash_path

LIMIT, HOT, CODED, PARTS = 5, 20_000, 65_536, 2
#: Tokens, and bytes of texts, that a task counts together; tokens for which there is a bucket.
BUFFER_TOKENS, BUFFER_BYTES, BUCKET_TOKENS = 1_000_000, 64 << 20, 600_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes have this bit, numbers don't. The end is a word like others, but with a hash of its own; the start has number 0.
COLD = 1 << 63
END, START = 0x14057B7EF767814F | COLD, 0


def place(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Words:
    """Hashes of words, or their numbers where they have one."""

    def __init__(self, coded: np.ndarray) -> None:
        self.order = np.argsort(coded)
        self.coded = coded[self.order]

    def __call__(self, words: pa.Array) -> np.ndarray:
        """Of the start, the end and the words, in this order."""
        hashes = map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False))
        h = np.append([np.uint64(END)], np.fromiter(hashes, np.uint64, len(words)) | np.uint64(COLD))
        at, has = place(h, self.coded)
        if len(self.coded):
            h[has] = self.order[at[has]] + 1
        return np.append([np.uint64(START)], h)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v * _ODD) ^ (v >> np.uint64(29)) ^ (w * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten()
    full = pc.binary_length(found).to_numpy() > 0  # there is an empty one beside white space at an end
    before = np.append(0, np.cumsum(full))[lists.offsets.to_numpy()]
    return found.filter(pa.array(full)), np.diff(before)


def _buffers(batches: Iterator[pa.RecordBatch], words: Words):
    """(row ids, list of words in order, and of each token: its place there, that of the one before, its row) of many texts at a time."""
    ids, parts, n, size = [], [], 0, 0

    def buffer():
        distinct = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        listed = words(distinct.dictionary)
        order = np.argsort(listed, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        lengths = np.concatenate([p[1] for p in parts]) + 1
        ends = np.cumsum(lengths)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        w = np.full(ends[-1], rank[1])
        w[inner] = rank[2:][distinct.indices.to_numpy()]
        v = np.concatenate([w[:1], w[:-1]])
        v[ends - lengths] = rank[0]
        return np.array(ids, np.int64), listed[order], w, v, np.repeat(np.arange(len(ids), dtype=np.uint64), lengths)

    for whole in batches:
        for b in slices(whole):
            ids += b.column(0).to_pylist()
            parts.append(split(b.column(1)))
            n += len(parts[-1][0]) + b.num_rows
            size += b.nbytes
            if n >= BUFFER_TOKENS or size >= BUFFER_BYTES or len(ids) >= 60_000:
                yield buffer()
                ids, parts, n, size = [], [], 0, 0
    if ids:
        yield buffer()


def in_order(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows of columns of numbers, sorted by the first, then the second, and so on: as bits of one key, or of few."""
    groups, room = [], 0
    for c in columns:
        bits = int(c.max(initial=0)).bit_length()
        if bits > room:
            groups.append([])
            room = 64
        groups[-1:] = [[*(groups or [[]])[-1], (c, bits)]]
        room -= bits
    keys = []
    for g in groups:
        key = np.zeros(len(columns[0]), np.uint64)
        for c, bits in g:
            key = (key << np.uint64(bits)) | c if bits < 64 else c
        keys.append(key)
    keys = [np.sort(keys[0])] if len(keys) == 1 else [k[o] for o in [np.lexsort(keys[::-1])] for k in keys]
    out = []
    for key, g in zip(keys, groups):
        part = []
        for _, bits in reversed(g):
            part.append(key & np.uint64((1 << bits) - 1))
            key = key >> np.uint64(bits) if bits < 64 else key
        out.extend(reversed(part))
    return out


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as differences, with equal bytes of all keys together: less to shuffle."""
    gaps = np.concatenate([keys[:1], keys[1:] - keys[:-1]]).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def packed_codes(x: np.ndarray) -> bytes:
    """Numbers in 4 bytes and hashes in 8, with a bit for each that tells which."""
    cold = x >= np.uint64(COLD)
    small = x[~cold].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x).to_bytes(8, "little") + np.packbits(cold).tobytes() + small + x[cold].astype("<u8").tobytes()


def unpacked_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    at = 8 + (n + 7) // 8
    cold = np.unpackbits(np.frombuffer(data[8:at], np.uint8), count=n).astype(bool)
    end = at + 4 * int(n - cold.sum())
    x = np.empty(n, np.uint64)
    x[~cold] = np.ascontiguousarray(np.frombuffer(data[at:end], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    x[cold] = np.frombuffer(data[end:], "<u8")
    return x


def bucket_of(v: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Where a pair is counted: by its first word if that has no number, else by both."""
    key = np.where(v >= np.uint64(COLD), v, pair_key(v, w))
    return (key >> np.uint64(20)) % np.uint64(buckets)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c) of all words, by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, listed, w, _, _ in _buffers(batches, Words(np.empty(0, np.uint64))):
            n = np.bincount(w.astype(np.int64), minlength=len(listed))
            yield pa.RecordBatch.from_arrays([pa.array(listed[n > 0].view(np.int64)), pa.array(n[n > 0])], ["w", "n"])

    return docs.select(F.lit(0).cast("long").alias("id"), "text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("c"))


def pair_counts(docs: DataFrame, coded: np.ndarray, buckets: int) -> DataFrame:
    """A row for each bucket: its pairs (v, w) in order and their counts c, packed, and how many of them occur r times (tally)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, listed, w, v, _ in _buffers(batches, Words(coded)):
            bucket, v, w = in_order(bucket_of(listed[v], listed[w], buckets), v, w)
            first = np.flatnonzero(_starts(bucket, v, w))
            n = np.diff(np.append(first, len(w))).astype(np.uint32)
            bucket, v, w = bucket[first], listed[v[first]], listed[w[first]]
            cuts = np.append(np.flatnonzero(_starts(bucket)), len(first)).tolist()
            rows = [(int(bucket[i]), packed(v[i:j]), packed_codes(w[i:j]), n[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "v", "w", "n"])

    def add(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        v = np.concatenate([unpacked(x) for x in sent.column("v").to_pylist()])
        w = np.concatenate([unpacked_codes(x) for x in sent.column("w").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in sent.column("n").to_pylist()])
        o = np.lexsort((w, v))
        v, w = v[o], w[o]
        first = np.flatnonzero(_starts(v, w))
        c = np.add.reduceat(n[o].astype(np.int64), first)
        tally = np.bincount(c[c <= LIMIT + 1], minlength=LIMIT + 2).tolist()
        row = [[key[0].as_py()], [packed(v[first])], [packed_codes(w[first])], [packed_codes(c.astype(np.uint64))], [tally]]
        return pa.table([pa.array(row[0], pa.int64()), *map(pa.array, row[1:4]), pa.array(row[4], pa.list_(pa.int64()))], ["bucket", "v", "w", "c", "tally"])

    sent = docs.select(F.lit(0).cast("long").alias("id"), "text").mapInArrow(count, "bucket long, v binary, w binary, n binary")
    return sent.groupBy("bucket").applyInArrow(add, "bucket long, v binary, w binary, c binary, tally array<long>")


def cold_words(w: np.ndarray) -> np.ndarray:
    return np.unique(w[w >= np.uint64(COLD)])


def with_word_counts(grams: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each bucket as before, with cw: counts of those second words that have no number, in the order of their hashes."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cold = cold_words(unpacked_codes(w))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cold), key, np.int64)), pa.array(cold.view(np.int64))], ["bucket", "w"])

    def put(own: pa.Table, counts: pa.Table) -> pa.Table:
        w, c = counts.column("w").to_numpy().view(np.uint64), counts.column("c").to_numpy()
        cw = packed_codes(c[np.argsort(w)].astype(np.uint64))
        return own.select(["bucket", "v", "w", "c"]).append_column("cw", pa.array([cw]))

    counts = grams.select("bucket", "w").mapInArrow(wanted, "bucket long, w long").join(words.select("w", "c"), "w")
    return grams.drop("tally").groupBy("bucket").cogroup(counts.select("bucket", "w", "c").groupBy("bucket")).applyInArrow(put, "bucket long, v binary, w binary, c binary, cw binary")


def discounts(counts: dict[int, int], least: int = 1) -> list[float]:
    """Good-Turing factors of counts from 1 to LIMIT (absolute discounting where one isn't within 0 and 1); counts under least are left to backoff."""
    n = [0] + [counts.get(r, 0) for r in range(1, LIMIT + 2)]
    a = (LIMIT + 1) * n[LIMIT + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, LIMIT + 1):
        turing = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and a < 1 else 0.0
        out.append(turing if 0 < turing < 1 else (r - 0.5) / r)
    return [0.0] * (least - 1) + out[least - 1 :]


class Rule:
    """What the counts of counts say: factors of word and pair counts, and all tokens. It goes to all tasks."""

    def __init__(self, d1: list[float], d2: list[float], tokens: int, flat: bool, least: int) -> None:
        self.d1, self.d2 = np.array([0.0, *d1, 1.0]), np.array([0.0, *d2, 1.0])
        self.n, self.flat, self.least = float(max(tokens, 1)), flat, least

    def p(self, c: np.ndarray) -> np.ndarray:
        """P of words that occur c times."""
        return (c - 0.5 if self.flat else c * self.d1[np.minimum(c, LIMIT + 1)]) / self.n

    def d(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts of pairs; 0 for those left to backoff."""
        return np.where(c >= self.least, c * self.d2[np.minimum(c, LIMIT + 1)], 0.0)


def weights(cv: np.ndarray, seen: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of alpha(v), and what v adds to the correction of its seen pairs, by v's count, its pairs' discounted counts and their words' P."""
    some = seen > 0
    cv, share = np.where(some, cv, 1).astype(float), np.where(some, seen, 0.5) / np.where(some, cv, 1)
    left = np.maximum(1 - share, 1 / (cv + 1))
    la = np.where(some, np.log10(left / np.where(some, 1 - known, 1.0)), 0.0)
    return la, np.where(some, np.log10((1 - left) / share / cv) - la, 0.0)


class Bucket:
    """The pairs of one bucket: v, w, c, P(w), discounted c, and the sums over the pairs of each v."""

    def __init__(self, row: dict, rule: Rule, p: np.ndarray) -> None:
        self.v, self.w, self.c = unpacked(row["v"]), unpacked_codes(row["w"]), unpacked_codes(row["c"]).astype(np.int64)
        cold = self.w >= np.uint64(COLD)
        self.p = np.empty(len(self.w))
        self.p[~cold] = p[self.w[~cold].astype(np.int64)]
        self.p[cold] = rule.p(unpacked_codes(row["cw"]).astype(np.int64))[np.searchsorted(cold_words(self.w), self.w[cold])]
        self.d = rule.d(self.c)
        first = np.flatnonzero(_starts(self.v))
        self.of = np.cumsum(_starts(self.v)) - 1
        self.vs = self.v[first]
        self.cv, self.seen, self.known = (np.add.reduceat(x, first) for x in (self.c, self.d, np.where(self.d > 0, self.p, 0.0)))


class Model:
    """coded: hashes of words with numbers, the end among them; by number p, c, la (log10 of alpha) and g (what v adds to a correction). grams: the pairs of each bucket."""

    def __init__(self, train: DataFrame, least: int) -> None:
        spark = train.sparkSession
        all_at = stash_path(word_counts(train), "counts")
        words = spark.read.parquet(all_at)
        sums = words.agg(F.count("*").alias("v"), F.sum("c").alias("n"), *(F.sum(F.when(F.col("c") == r, 1)).alias(f"n{r}") for r in range(1, LIMIT + 2))).first()
        self.types, self.tokens = sums.v, sums.n or 0
        self.buckets = max(1, math.ceil(self.tokens / BUCKET_TOKENS))
        size = F.floor(F.log2("c") * 8)
        classes = words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()  # a few hundred at most
        least_size, n = math.inf, 0
        for k in classes:
            n += k.n
            if n > CODED:
                break
            least_size = k.size
        numbered = (size >= F.lit(float(least_size))) | (F.col("w") == F.lit(END - (1 << 64)))
        top = sorted(words.where(numbered).collect(), key=lambda r: (-r.c, r.w))  # at most CODED and the end
        self.coded = np.array([r.w for r in top], np.int64).view(np.uint64)
        d1 = discounts({r: sums[f"n{r}"] or 0 for r in range(1, LIMIT + 2)})
        coded, buckets = self.coded, self.buckets
        pairs_at = stash_path(pair_counts(train, coded, buckets), "pairs", compression="zstd")
        pairs = spark.read.parquet(pairs_at)
        tally = {r.pos: r.n for r in pairs.select(F.posexplode("tally").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
        d2 = discounts({r: tally.get(r, 0) for r in range(1, LIMIT + 2)}, least)
        kept = F.sum(F.col("c") * F.when(F.col("c") <= LIMIT, F.element_at(F.array(*map(F.lit, d1)), F.least("c", F.lit(LIMIT)).cast("int"))).otherwise(1.0))
        mass = (words.agg(kept).first()[0] or 0.0) / max(self.tokens, 1)
        flat = bool(self.tokens) and 1 - mass < 1e-9
        self.rule = rule = Rule(d1, d2, self.tokens, flat, least)
        self.unknown = 0.5 * self.types / self.tokens if flat else 1 - mass
        self.c = np.array([0, *(r.c for r in top)], np.int64)
        self.p = p = np.concatenate([[1.0], rule.p(self.c[1:])])
        grams_at = stash_path(with_word_counts(pairs, words.where(~numbered)), "grams", compression="zstd")
        self.grams = spark.read.parquet(grams_at)
        drop_path(spark, pairs_at)

        def sums_by_v(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in range(batch.num_rows):
                    b = Bucket(batch.slice(part, 1).to_pylist()[0], rule, p)
                    k = int(np.searchsorted(b.vs, np.uint64(COLD)))  # those with numbers come first
                    yield pa.RecordBatch.from_arrays([pa.array(x[:k]) for x in (b.vs.view(np.int64), b.cv, b.seen, b.known)], ["v", "cv", "seen", "known"])

        by_v = self.grams.mapInArrow(sums_by_v, "v long, cv long, seen double, known double").groupBy("v").agg(*(F.sum(x).alias(x) for x in ("cv", "seen", "known")))
        self.la, self.g = np.zeros(len(self.c)), np.zeros(len(self.c))
        mine = by_v.collect()  # at most CODED, the end and the start
        at = np.array([r.v for r in mine], np.int64)
        self.la[at], self.g[at] = weights(*(np.array([r[x] for r in mine], float) for x in ("cv", "seen", "known")))
        drop_path(spark, all_at)


SUMS = ("score", "base", "known", "tokens")
#: How many of the sums an answer has: of what needs no bucket, and of a bucket.
HAVE = {0: 4, 1: 3}


def gather(got: pa.Table) -> pa.Table:
    """Sums by row of the answers to one task's buffer."""
    rid = np.concatenate([np.frombuffer(x, np.int64) for x in got.column("rids").to_pylist()])
    names, at = np.unique(rid, return_inverse=True)
    sums, i = np.zeros((len(SUMS), len(names))), 0
    for kind, data in zip(got.column("kind").to_pylist(), got.column("sums").to_pylist()):
        own = np.frombuffer(data, np.float64).reshape(HAVE[kind], -1)
        for total, x in zip(sums, own):
            np.add.at(total, at[i : i + own.shape[1]], x)
        i += own.shape[1]
    return pa.table([names, *sums], ["rid", *SUMS])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(rid, score, base, known, tokens): sums over the tokens of each (rid, text)."""
    spark = docs.sparkSession
    buckets, rule, coded = model.buckets, model.rule, model.coded
    least = max(1, model.tokens // HOT)
    total = math.log10(model.tokens + model.types + 1)
    none = (math.log10(max(model.unknown, 1e-300)), -total)
    p, g, start = model.p, model.g, float(model.la[START])
    # by number; the last are of a word without number, whose bucket adds the rest, and of an unknown end, which no bucket has
    of_words = [np.append(x, y) for x, y in ((np.log10(p) + model.la, [0.0, none[0]]), (np.log10(model.c + 1) - total, [0.0, none[1]]), (np.ones(len(p)), [0.0, 0.0]))]

    def fixes(b: Bucket, g_of_v: np.ndarray) -> np.ndarray:
        """What a pair's log10 is above backoff; 0 for pairs left to it."""
        return np.where(b.d > 0, np.log10(np.where(b.d > 0, b.d, 1.0)) + g_of_v - np.log10(b.p), 0.0)

    def is_hot(b: Bucket) -> np.ndarray:
        return (b.c >= least) & (b.v < np.uint64(COLD)) & (b.w < np.uint64(COLD))

    def hot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(batch.num_rows):
                b = Bucket(batch.slice(part, 1).to_pylist()[0], rule, p)
                hot = is_hot(b)
                fix = fixes(b, g[np.where(hot, b.v, 0).astype(np.int64)])[hot]
                yield pa.RecordBatch.from_arrays([pa.array(pair_key(b.v[hot], b.w[hot]).view(np.int64)), pa.array(fix)], ["key", "fix"])

    hot = model.grams.mapInArrow(hot_pairs, "key long, fix double").collect()  # at most 2 * HOT: their counts sum to at most all
    hp = np.array([r.key for r in hot], np.int64).view(np.uint64)
    op = np.argsort(hp)
    sent = spark.sparkContext.broadcast((hp[op], np.array([r.fix for r in hot], float)[op]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions for the buckets: pairs in order, how many rows have each, these rows and their counts. Kind 0 are sums that need no bucket, 1 pairs."""
        hot_p, val_p = sent.value
        task = TaskContext.get().partitionId() << 32
        for asker, (rid, listed, w, v, row) in enumerate(_buffers(batches, Words(coded)), task):
            number = np.where(listed < np.uint64(COLD), listed, np.uint64(len(p)) + (listed == np.uint64(END))).astype(np.int64)
            bucket, v, w, r = in_order(bucket_of(listed[v], listed[w], buckets), v, w, row)
            first = np.flatnonzero(_starts(bucket, v, w, r))
            n = np.diff(np.append(first, len(w)))
            bucket, v, w, r = bucket[first], listed[v[first]], w[first], r[first].astype(np.int64)
            of_w, w = number[w], listed[w]
            sums = np.stack([*(np.bincount(r, x[of_w] * n, len(rid)) for x in of_words), np.bincount(r, n, len(rid))])
            at, known = place(pair_key(v, w), hot_p)
            sums[0] += start + np.bincount(r[known], val_p[at[known]] * n[known], len(rid))
            bucket, v, w, r, n = (x[~known] for x in (bucket, v, w, r, n))
            cuts = np.append(np.flatnonzero(_starts(bucket)), len(bucket)).tolist()
            out = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                names, local = np.unique(r[i:j], return_inverse=True)
                new = np.flatnonzero(_starts(v[i:j], w[i:j]))
                runs = np.diff(np.append(new, j - i))
                keys = packed(v[i:j][new]), packed_codes(w[i:j][new])
                out.append((int(bucket[i]), asker, 1, *keys, packed_codes(runs.astype(np.uint64)), local.astype(np.uint16).tobytes(), packed_codes(n[i:j].astype(np.uint64)), rid[names].tobytes()))
            out.append((int(rid[0] % buckets), asker, 0, b"", sums.tobytes(), b"", b"", b"", rid.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["bucket", "asker", "kind", "v", "w", "runs", "row", "n", "rids"])

    def answer(questions: pa.Table, table: pa.Table) -> pa.Table:
        """For each question the sums by row of what a bucket has for its pairs, and for their first words that have no number."""
        keys, fix, vs = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.uint64)
        of_v = [np.empty(0)] * 3
        if table.num_rows:
            b = Bucket(table.to_pylist()[0], rule, p)
            cold = b.vs >= np.uint64(COLD)
            la, by_v = weights(b.cv, b.seen, b.known)
            by_v = np.where(cold, by_v, g[np.where(cold, 0, b.vs).astype(np.int64)])
            keys, fix = pair_key(b.v, b.w), fixes(b, by_v[b.of])
            o = np.argsort(keys)
            keys, fix, vs, c = keys[o], fix[o], b.vs[cold], b.cv[cold]
            of_v = [np.log10(rule.p(c)) + la[cold], np.log10(c + 1) - total, np.ones(len(c))]
        done = []
        for q in questions.to_batches():
            for asker, kind, v, w, runs, row, n, rids in zip(*(q.column(c).to_pylist() for c in ("asker", "kind", "v", "w", "runs", "row", "n", "rids"))):
                if kind == 0:
                    done.append((asker, kind, rids, w))
                    continue
                v, w, runs, row = unpacked(v), unpacked_codes(w), unpacked_codes(runs).astype(np.int64), np.frombuffer(row, np.uint16).astype(np.int64)
                n, rows = unpacked_codes(n).astype(np.float64), len(rids) // 8
                at, has = place(pair_key(v, w), keys)
                values = np.where(has, fix[at], 0.0) if len(fix) else np.zeros(len(v))
                k = int(np.searchsorted(v, np.uint64(COLD)))  # first words without number come last
                new = np.flatnonzero(_starts(v[k:]))
                asked = np.diff(np.append(new, len(v) - k))
                at, has = place(v[k:][new], vs)
                words = [np.repeat(np.where(has, x[at], e) if len(x) else np.full(len(at), e), asked) for x, e in zip(of_v, (*none, 0.0))]
                values[k:] += words[0]
                sums = [np.bincount(row, np.repeat(values, runs) * n, rows)]
                row, n, runs = row[len(row) - runs[k:].sum() :], n[len(n) - runs[k:].sum() :], runs[k:]
                sums += [np.bincount(row, np.repeat(x, runs) * n, rows) for x in words[1:]]
                done.append((asker, kind, rids, np.concatenate(sums).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 4, kinds)], ["asker", "kind", "rids", "sums"])

    def found(rows: DataFrame) -> DataFrame:
        asked = rows.select("rid", "text").mapInArrow(ask, "bucket long, asker long, kind long, v binary, w binary, runs binary, row binary, n binary, rids binary")
        sums = asked.groupBy("bucket").cogroup(model.grams.groupBy("bucket")).applyInArrow(answer, "asker long, kind long, rids binary, sums binary")
        return sums.groupBy("asker").applyInArrow(gather, "rid long, " + ", ".join(f"{c} double" for c in SUMS))

    # one after the other: questions are what takes most room
    parts = [stash(found(docs.where(F.pmod("rid", F.lit(PARTS)) == part)), "found") for part in range(PARTS)]
    both = functools.reduce(DataFrame.union, parts)
    return both.groupBy("rid").agg(*(F.sum(c).alias(c) for c in SUMS))


def held_out(id_col: str) -> Column:
    return F.coalesce(crc_mod(id_col, 7) == 2, F.lit(False))


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, learned from those that aren't held out. Pairs that occur fewer than ``least`` times there are left to backoff."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    model = Model(rows.where(~held_out("id")), least)
    rid = F.xxhash64("id", "text")
    facts = rows.select(rid.alias("rid"), "id").groupBy("rid").agg(F.first("id").alias("id"), F.count("*").alias("times"))
    found = score(rows.select(rid.alias("rid"), "text"), model)
    out = facts.join(found, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    t = F.col("times")
    return out.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        (F.col("tokens") / t).cast("long").alias("n_tokens"),
        (F.col("known") / t).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / t).alias("base_score"),
        (F.col("score") / t).alias("score"),
    )
