import pytest
from pyspark.sql import functions as F

from dossier.llm import mixing, queries

from .conftest import frame


def goals(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight, capped one after another until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest, by = total - sum(fixed.values()), sum(w[s] for s in free)
        now = {s: rest * w[s] / by for s in free}
        over = [s for s in free if now[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **now}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    sizes = {"b": 100, "a": 5, "c": 1000, None: 50, "z": 300, "é": 7, "A": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(goals(sizes))


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", ["hot", "b", "c", None][0 if i % 3 else i % 4], 1) for i in range(1500)]
    df = frame(spark, rows)
    out = mixing.mix(df)
    got = out.select("doc_id", "source", "mix.*").collect()
    assert len(got) == 1500 and all(len(r.shards) <= 2 for r in got)
    for source in ("hot", "b", "c", None):
        mine = [r for r in got if r.source == source]
        taken, size = sum(r.size * len(r.shards) for r in mine), sum(r.size for r in mine)
        assert {r.source_size for r in mine} == {size} and abs(taken - mine[0].target) <= 0.02 * mine[0].target
    again = {r.doc_id: r.mix for r in mixing.mix(df.repartition(7)).collect()}
    assert all(tuple(again[r.doc_id].shards) == tuple(r.shards) for r in got)
    made = mixing.copies(out)
    assert made.count() == sum(len(r.shards) for r in got) and set(made.columns) == {*df.columns, "shard"} - {"mix"}
    shares = [r["count"] for r in made.groupBy("shard").count().collect()]
    assert len(shares) == 2**mixing.SHARDS_LOG2 and min(shares) > 0.5 * max(shares)


def test_edges(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].mix.size == 0 and by[3].mix.source_size == by[6].mix.source_size
    assert mixing.mix(empty).count() == 0 and mixing.copies(mixing.mix(empty)).count() == 0
    assert mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).count() == odd.count()


def test_query(spark, sf, documents):
    """The whole table: sizes as counted, targets as the loop's, words taken near them, and no document beyond twice its size."""
    rows = {r.doc_id: r for r in queries.op8_mixing(spark, sf).collect()}
    docs = documents.collect()
    assert len(rows) == len(docs)
    sizes: dict = {}
    for d in docs:
        n = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", d.text or "") if w])
        assert rows[d.doc_id].size == n and rows[d.doc_id].taken in (0, n, 2 * n)
        sizes[d.source] = sizes.get(d.source, 0) + n
    want = goals(sizes)
    largest = max(rows[d.doc_id].size for d in docs)
    for source, size in sizes.items():
        mine = [rows[d.doc_id] for d in docs if d.source == source]
        assert {r.source_size for r in mine} == {size} and mine[0].target == pytest.approx(want[source])
        assert abs(sum(r.taken for r in mine) - want[source]) <= max(0.02 * want[source], largest)


def test_tree_draws_each_copy_once(spark):
    """Every block that the mix takes is drawn by one shard for each copy, and shards differ by a block at most in each split."""
    sized = spark.createDataFrame([(s, 10, b, p) for s in "ab" for b in range(64) for p in range(2)], "source string, size long, block int, part int")
    out = mixing.plan(sized, 3).collect()
    drawn = [shard for r in out for shards in (r.draws or {}).values() for shard in shards] + [r.part_shard for r in out if r.part_shard is not None]
    goal = goals({"a": 1280, "b": 1280})
    for r in out:
        whole = sum(len(x) for x in (r.draws or {}).values())
        assert abs(whole * 20 + 10 * len(r.parts or []) * (r.part_shard is not None) - goal[r.source]) <= 10
        assert all(len(x) in (int(r.target // 1280), int(r.target // 1280) + 1) for x in r.draws.values())
    tally = [drawn.count(k) for k in range(2**mixing.SHARDS_LOG2)]
    assert sum(tally) == len(drawn) and max(tally) - min(tally) <= mixing.SHARDS_LOG2
