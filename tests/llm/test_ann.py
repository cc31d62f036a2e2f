import numpy as np
import pytest

from dossier.llm import ann


def brute(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = set()
    for i, v in rows:
        if i % every == 0:
            d = ((x - np.array(v, float)) ** 2).sum(1)
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out |= {(i, n + 1, int(ids[j])) for n, j in enumerate(order)}
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(64) + 3 * (i % 5 == 0)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(30)]  # one vector many times
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = brute(rows, 100, 10)
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df).collect()}
    assert len(got & want) / len(want) >= 0.9
    # the bounds leave most vectors out
    assert len(got) == len(want)


def test_bounds_choose(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    turn, centre = ann.rotation(64, 0), x.mean(0)
    near = ann.Nearest(np.arange(5), x[:5], centre, turn, 10, ann.EPSILON)
    near.see(np.arange(4000), x, *ann.encode(x, centre, turn))
    assert near.reranked < 5 * 4000


def test_edges(spark):
    good = [(i * 100, [float(i + 1), 2.0]) for i in range(4)]
    bad = [(900, None), (1000, []), (1100, [0.0, 0.0]), (1200, [1.0, None]), (1300, [float("nan"), 1.0]), (1400, [float("inf"), 1.0]), (1500, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    rows = ann.nearest(df).collect()
    assert {r.query_id for r in rows} == {0, 100, 200, 300} and len(rows) == 12  # 1500 is alone in its length
    assert [r.score for r in sorted(rows, key=lambda r: (r.query_id, r["rank"]))][:3] == pytest.approx([1, 2, 3])
    assert ann.nearest(df.limit(0)).count() == 0


def test_lengths_and_repeated_queries(spark):
    """Each length is searched for itself; a query that is given twice has two lists."""
    short = [(i, [float(i % 7 + 1), 1.0]) for i in range(0, 1000, 20)]
    long = [(i, [1.0, float(i % 11), 2.0]) for i in range(1, 1001, 20)] + [(2000, [1.0, 3.0, 2.0])]
    rows = ann.nearest(spark.createDataFrame(short + long + [short[0]], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in rows.collect())
    assert {x for x in got if x[0] == 2000} == {x for x in brute(long, 100, 10) if x[0] == 2000}
    mine = [x for x in got if x[0] == 0]
    assert mine == sorted(2 * [x for x in brute(short, 100, 10) if x[0] == 0]) and [r for _, r, _ in mine] == sorted(2 * list(range(1, 11)))
    assert {x for x in got if 0 < x[0] < 1000} == {x for x in brute([*short, short[0]], 100, 10) if x[0]}


def test_estimates_are_within_the_rounding():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 100):
        x = rng.standard_normal((300, dim))
        turn, centre = ann.rotation(dim, 0), x.mean(0)
        near = ann.Nearest(np.arange(7), x[:7], centre, turn, 5, ann.EPSILON)
        code, _, _ = ann.encode(x, centre, turn)
        signs = np.where((x - centre) @ turn > 0, 1, -1) / np.sqrt(dim)
        off = np.abs(near.inner(slice(0, 7), code, dim) - near.turned @ signs.T)
        assert (off <= near.step[:, None] * np.sqrt(dim) / 2 + 1e-4).all()


def test_blocks_of_queries(spark):
    """Many small blocks find what one block finds, whether vectors are stored as floats or as doubles."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(1200)]
    found = []
    for kind, size in (("float", ann.QUERY_BYTES), ("float", 3 * 16 * 8), ("double", ann.QUERY_BYTES)):
        own, dims = ann.valid(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), "vec_id", "embedding")
        indexed, centre = ann.index(own, 16)
        assert dims == [16] and dict(indexed.dtypes)["v"] == f"array<{kind}>"
        parts = ann.search(indexed, own.where("id % 100 = 0"), 16, centre, query_bytes=size)
        assert len(parts) == 1 if size == ann.QUERY_BYTES else len(parts) > 2
        found.append({(r.query_id, r["rank"], r.vec_id, r.score) for part in parts for r in part.collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 120
