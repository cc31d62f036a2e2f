import random
import re

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import near_dup
from dossier.llm.common import stash_path
from dossier.llm.components import components, extend_path

from .conftest import frame


def brute(rows, words, percent):
    """(component, set size) by id, from all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), len(sets[i])) for i in ids}


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows, i = [], 0
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(60)]
        for _ in range(12):  # copies with one to eight changed words: some alike, some not, chains between them
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(60)] = rng.choice(vocab)
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(40):  # a passage that many share, without being alike
        rows.append((i, " ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(3, 40))])))
        i += 1
    rng.shuffle(rows)
    return rows


def test_as_all_pairs(spark):
    rows = texts()
    want = brute(rows, 2, 80)
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(df, 2, 80).collect()}
    assert got == want
    assert len({c for c, _ in want.values()}) < len(want)


def test_repeated_rows_in_the_fallback(spark, monkeypatch):
    """Without rounds, what isn't linked with an end of its bucket is left to the rarest shingles, whose counts repeated rows mustn't change."""
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    rows = texts()
    want = brute(rows, 2, 80)
    # every third row again, and every ninth once more with a text that has the same set
    again = [(i, t) for i, t in rows if i % 3 == 0] + [(i, t.upper().replace(" ", "  ")) for i, t in rows if i % 9 == 0]
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in rows + again])
    got = near_dup.near_duplicates(df, 2, 80).collect()
    assert len(got) == len(rows) + len(again)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == want


def test_rarest_shingles_of_repeated_rows(spark):
    """A document that is there twice, or with two texts, meets one that is there once."""
    words = [f"w{i}" for i in range(60)]
    one, other, last = " ".join(words), " ".join([*words[:30], "x", *words[31:]]), " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(1, one), (1, one), (1, one.upper()), (2, other), (3, last), (3, one)], "id long, text string")
    ids = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, c long")
    sets = near_dup.set_table(docs, ids.select("id"), 2)
    got = {tuple(r) for r in near_dup.prefix_pairs(ids, sets, 80).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_edges(odd, empty):
    rows = near_dup.near_duplicates(odd, 2).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() - 1 and None not in by
    assert by[6].component_id == 1 and not by[6].kept and by[1].kept
    assert by[2].n_shingles == by[3].n_shingles == by[5].n_shingles == 0 and by[2].kept and by[3].kept
    assert by[7].n_shingles == 1 and by[7].kept
    assert near_dup.near_duplicates(empty, 2).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component_id for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.where(F.lit(False))).count() == 0


def test_links_added_to_components(spark):
    """Old components, ids without links and new chains between them are as if all links had come at once."""
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    frames = [spark.createDataFrame(part, "a long, b long") for part in (links[:60], links[60:100], links[100:])]
    at = stash_path(components(frames[0]), "labels")
    for more in frames[1:]:
        at = extend_path(at, more)
    got = {r.id: r.component_id for r in spark.read.parquet(at).collect()}
    want = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    # an id whose only link is with itself isn't in the first table
    assert {k: v for k, v in got.items() if k in want} == want and all(k == v for k, v in got.items() if k not in want)
    at = extend_path(at, frames[0].limit(0))
    assert {r.id: r.component_id for r in spark.read.parquet(at).collect()} == got


def test_sketches_bound_the_difference():
    """Sketches, and folded ones, never differ in more bits than the sets in shingles: no link is ruled out."""
    rng = np.random.default_rng(4)
    for size in (1, 5, 80, 3000):
        for share in (0.0, 0.5, 0.9, 1.0):
            one = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            other = np.unique(np.concatenate([one[: int(size * share)], rng.integers(0, 1 << 63, max(1, size // 7), np.uint64)]))
            apart = len(np.setxor1d(one, other))
            x, y = near_dup.sketch(one), near_dup.sketch(other)
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= apart
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, near_dup.FOLDED)) for v in (x, y))
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= apart


def test_pairs_grow_with_documents(spark, monkeypatch):
    """Copies of one text that lack 6 % of its words are near the threshold with each other; twice as many take far from four times as many pairs."""
    real, pairs = near_dup.confirmed, []

    def counted(found, sets, percent):
        pairs.append(found.count())
        return real(found, sets, percent)

    monkeypatch.setattr(near_dup, "confirmed", counted)
    rng, totals = random.Random(3), []
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(w for w in base if rng.random() >= 0.06)) for i in range(160)]
    for n in (80, 160):
        pairs.clear()
        df = frame(spark, [(i, t, "en", "s", 1) for i, t in rows[:n]])
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(df, 2, 80).collect()}
        assert got == brute(rows[:n], 2, 80)
        totals.append(sum(pairs))
    assert totals[1] < 5 * 160 and totals[1] < 3.2 * totals[0]


def test_candidates_of_rounds_are_ruled_out_before_they_are_rows(spark, monkeypatch):
    """In the rounds, a document's candidates stay in one row: only the ends of buckets and the rarest shingles make rows of pairs for sketches to judge."""
    real, pairs, met, few = near_dup.possible, [], [], near_dup.met_few

    def counted(found, classes, percent):
        pairs.append(found.count())
        return real(found, classes, percent)

    def kept(labelled, pivots, classes, percent, turn):
        out = few(labelled, pivots, classes, percent, turn)
        most = out.groupBy("a").count().agg(F.max("count")).first()[0] or 0
        # what is left is what sizes and sketches allow, and no more of it than a round takes
        assert most <= near_dup.MET and real(out, classes, percent).count() == out.distinct().count() == out.count()
        met.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "possible", counted)
    monkeypatch.setattr(near_dup, "met_few", kept)
    rows = texts()
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), 2, 80).collect()}
    assert got == brute(rows, 2, 80)
    assert len(pairs) == 2 and len(met) == near_dup.ROUNDS and sum(met) > 0
