import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import common, katz

from .conftest import frame


def tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    return [w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [0]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for i, text in rows:
        if not held(i):
            w = tokens(text)
            one.update(w)
            two.update(zip([1, *w[:-1]], w))
    total, types = sum(one.values()), len(one)
    d1, d2 = katz.discounts(Counter(one.values())), katz.discounts(Counter(two.values()), 2)
    factor = lambda c, d: d[c - 1] if c <= katz.LIMIT else 1.0
    p = {w: c * factor(c, d1) / total for w, c in one.items()}
    unknown = 1 - sum(p.values())
    seen = defaultdict(dict)
    for (v, w), c in two.items():
        if c > 1:
            seen[v][w] = c * factor(c, d2) / one[0 if v == 1 else v]
    alpha = {}
    for v, of in seen.items():
        left = max(1 - sum(of.values()), 1 / (one[0 if v == 1 else v] + 1))
        scale = (1 - left) / sum(of.values())
        seen[v] = {w: x * scale for w, x in of.items()}
        alpha[v] = left / (1 - sum(p[w] for w in of))
        # exactly normalised: seen words, unseen known words, and the unknown word
        rest = sum(x for w, x in p.items() if w not in of) + unknown
        assert sum(seen[v].values()) + alpha[v] * rest == pytest.approx(1, abs=1e-9)
    out = []
    for i, text in rows:
        w = tokens(text)
        s = sum(math.log10(seen[v][a] if a in seen.get(v, {}) else alpha.get(v, 1.0) * p.get(a, unknown)) for v, a in zip([1, *w[:-1]], w))
        out.append((i, held(i), len(w), sum(one[a] > 0 for a in w), total, sum(math.log10((one[a] + 1) / (total + types + 1)) for a in w), s))
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_as_a_loop(spark, documents, odd, monkeypatch, hot):
    """With all keys sent to the tasks, and with nearly all asked from buckets."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "CODED", 65_536 if hot > 5 else 30)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5000)
    df = documents.select("doc_id", "text").limit(100).union(odd.select("doc_id", "text"))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=key)
    got = sorted(map(tuple, katz.evaluate(df).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty(empty):
    assert katz.evaluate(empty).count() == 0


def test_discounts():
    assert katz.discounts({}) == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]
    d = katz.discounts({1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 35})
    assert all(0 < x < 1 for x in d) and d != katz.discounts({})
    assert katz.discounts({}, 2)[0] == 0.0


def test_pairs_that_occur_once(spark):
    """The query's model keeps every pair, each with the factor of its count."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 200)}" for _ in range(rng.randint(0, 30)))) for i in range(200)]
    train = [tokens(text) for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for text in train for w in text)
    two = Counter(p for text in train for p in zip([1, *text[:-1]], text))
    d1, d2 = katz.discounts(Counter(one.values())), katz.discounts(Counter(two.values()))
    kept = lambda c, d: c * (d[c - 1] if c <= katz.LIMIT else 1.0)
    p = {w: kept(c, d1) / sum(one.values()) for w, c in one.items()}
    seen = defaultdict(dict)
    for (v, w), c in two.items():
        seen[v][w] = kept(c, d2) / one[0 if v == 1 else v]
    alpha = {}
    for v, of in seen.items():
        left = max(1 - sum(of.values()), 1 / (one[0 if v == 1 else v] + 1))
        alpha[v] = left / (1 - sum(p[w] for w in of))
        seen[v] = {w: x * (1 - left) / sum(of.values()) for w, x in of.items()}
    want = {}
    for i, text in rows:
        pairs = zip([1, *tokens(text)[:-1]], tokens(text))
        want[i] = sum(math.log10(seen[v][w] if w in seen.get(v, {}) else alpha.get(v, 1.0) * p.get(w, 1 - sum(p.values()))) for v, w in pairs)
    assert sum(c == 1 for c in two.values()) > len(two) / 2
    got = {r.doc_id: r.score for r in katz.evaluate(frame(spark, [(i, text, "en", "s", 1) for i, text in rows]), least=1).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("most", [1, 100, 2**20, 2**40, 2**63])
def test_in_order(most):
    """Columns in one key, and in several where their bits don't fit."""
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, min(most, m), 500, dtype=np.uint64) for m in (190, 2**20, 2**63, 60_000)]
    order = np.lexsort(columns[::-1])
    assert all((got == c[order]).all() for got, c in zip(katz.in_order(*columns), columns))
    assert all(len(c) == 0 for c in katz.in_order(*(c[:0] for c in columns)))


def test_packed_codes():
    x = np.array([0, 7, katz.COLD, 2**32 - 1, katz.COLD | 12345, 1], np.uint64)
    assert (katz.unpacked_codes(katz.packed_codes(x)) == x).all()
    assert len(katz.unpacked_codes(katz.packed_codes(x[:0]))) == 0


def test_split():
    """As bytes.split does: white space at the ends, or alone, makes no words."""
    texts = ["", "  ", " a b ", "\ta\x0b\x0c\r\nb", "A\x1cB\x85c d\xa0e \x00 f", None, "ÄB é", " lead", "trail "]
    want = [tokens(t)[:-1] for t in texts]
    for given in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["cut off", *texts])[1:]):
        words, n = katz.split(given)
        assert words.to_pylist() == sum(want, []) and n.tolist() == [*map(len, want)]


@pytest.mark.parametrize("coded", [0, 3])
def test_words_without_numbers(spark, documents, monkeypatch, coded):
    """Nearly all words are asked for with their pairs, unknown ones too; texts are read for that once in each part, not once more for words."""
    monkeypatch.setattr(katz, "CODED", coded)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 3000)
    rows = [(r.doc_id, r.text) for r in documents.limit(40).collect()] + [(1_000_000 + i, f"never{i} seen") for i in range(20)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", counted("text").alias("text"))
    got = sorted(map(tuple, katz.evaluate(df).collect()))
    assert read.value <= (4 + katz.PARTS) * len(rows)  # for words, pairs, ids, what part a text is in, and once in its part
    for g, w in zip(got, sorted(brute(rows)), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_nothing_to_learn_from(spark):
    """All words, and the end, are unknown, with probability 1."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.evaluate(frame(spark, [(i, "some words" if i % 2 else None, "en", "s", 1) for i in ids])).collect()
    assert sorted(r.doc_id for r in got) == ids
    assert all((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3 if r.doc_id % 2 else 1, 0, 0, 0.0, 0.0) for r in got)


def test_shuffle_files_go_with_their_table(spark):
    """A written table takes the place of its shuffle files; Spark's setting is as it was after that."""
    def files(root):
        return sum(f.startswith("shuffle_") for _, _, names in os.walk(root) for f in names)

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    was, before = spark.conf.get(common.CLEANUP), files(root)
    table = common.stash(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    end = time.time() + 5
    while files(root) > before and time.time() < end:
        time.sleep(0.1)
    assert files(root) <= before and spark.conf.get(common.CLEANUP) == was
    assert table.count() == 7
