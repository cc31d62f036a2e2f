import hashlib
import math

import numpy as np
import pytest

from dossier.llm import balls
from dossier.llm.lookup import attach


def loop(rows, parts, entries, rounds, scale):
    """{row: (code, error)} and the codebooks, by plain loops over rows, parts and entries."""
    x = {n: [math.floor(c * scale) for c in v] for n, (_, v) in enumerate(rows)}
    first = sorted(x, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, rows[n][1]))[:entries]
    dim = len(rows[0][1])
    cut = lambda v, p: v[dim * p // parts : dim * (p + 1) // parts]
    books = [[cut(x[n], p) for n in first] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for v in x.values():
                held.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else c for j, c in enumerate(book)]
    out = {}
    for n, v in x.items():
        best = [near(cut(v, p), book) for p, book in enumerate(books)]
        out[n] = (bytes(j for _, j in best), sum(d for d, _ in best))
    return out, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


@pytest.mark.parametrize("entries, dim", [(7, 8), (40, 8), (256, 6), (3, 3)])
def test_equals_a_loop(spark, entries, dim):
    rng = np.random.default_rng(entries)
    # few values, so that there are ties and equal entries
    rows = [(n // 2 * 2, [float(c) / 4 for c in rng.integers(-3, 4, dim)]) for n in range(300)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = balls.compress(df, parts=4, entries=entries, scale=16).collect()
    want, digest = loop(rows, 4, entries, 4, 16)
    assert {r.label: (bytes(r.code), r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}


def test_rings_leave_most_entries_out():
    """Equal to the full scan at every round, with fewer distances."""
    rng = np.random.default_rng(0)
    x = (rng.integers(0, 40, (5000, 1)) * 500 + rng.integers(0, 60, (5000, 4))).astype(np.int64)
    book, code = balls.Balls(x[:40].copy()), None
    for n in range(6):
        best, least, met = book.assign(x, code)
        full, d, every = balls.Balls(book.entries).assign(x, None)
        assert (best == full).all() and (least == d).all()
        if n:
            assert met < every / 4
        gathered = balls.Gathered([book])
        gathered.see(0, x, best, least)
        book, code = book.moved({j: (c, far, np.array(s, dtype=object)) for _, j, c, far, s in gathered.rows()}), best.astype(np.uint8)
    for n in range(40):
        gathered = balls.Gathered([book])
        gathered.see(0, x, best, least)
        moved = book.moved({j: (c, far, np.array(s, dtype=object)) for _, j, c, far, s in gathered.rows()})
        best, least, met = moved.assign(x, best.astype(np.uint8))
        if (moved.entries == book.entries).all():
            break
        book = moved
    assert moved.still.all() and met == 0


def test_edges(spark):
    good = [(1, [0.5, -0.5, 0.25, 0.1]), (1, [0.5, -0.5, 0.25, 0.1]), (None, [0.1, 0.2, 0.3, 0.4])]
    bad = [(2, None), (3, [1.0, None, 1.0, 1.0]), (4, [float("nan")] * 4), (5, [float("inf")] * 4)]
    other = [(6, []), (7, [1.0]), (8, [0.0] * 5)]
    df = spark.createDataFrame([(*r, None, "x", "y") for r in good + bad + other], "vec_id long, embedding array<float>, label int, code string, error string")
    got = balls.compress(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert all(r.error == 0 and len(r.code) == 4 for r in got) and len({r.codebooks_sha256 for r in got}) == 4
    assert len({bytes(r.code) for r in got if r.vec_id == 1}) == 1
    assert balls.compress(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="in magnitude"):
        balls.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<double>, label int"))


def test_attach(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(60)], "id long, k int")
    table = spark.createDataFrame([(None, "none"), (1, "one"), (2, "two"), (9, "nine")], "k int, name string")
    want = {(i, {None: "none", 1: "one", 2: "two"}.get(None if i % 3 == 0 else i % 5)) for i in range(60)}
    for most in (10, 2):  # sent to all tasks, and dealt
        got = attach(rows, table, "k", "id", most=most, parts=3).collect()
        assert len(got) == 60 and {(r.id, r.name) for r in got} == want
