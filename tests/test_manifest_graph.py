"""Batch caps, samples, closure and similar names against plain loops."""

import difflib
from collections import defaultdict

from pyspark.sql import functions as F

from dossier.operators import entity, graph, manifest


def test_closure_of_a_long_chain(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(200)] + [("d", "l"), ("d", "r"), ("l", "top"), ("r", "top"), ("top", "roof"), ("x", "y"), ("y", "x"), (None, "x"), ("d", None)]
    got = {(r.child, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(rows, "child string, parent string")).collect()}
    assert all(got[f"n{i}", f"n{j}"] == j - i for i in range(0, 200, 17) for j in range(i + 1, 201))
    assert len([k for k in got if k[0].startswith("n")]) == 200 * 201 // 2
    assert got["d", "top"] == 2 and got["d", "roof"] == 3 and (got["x", "x"], got["x", "y"]) == (2, 1)
    assert graph.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_batch_cap_as_a_loop(spark):
    rows = [(i, i % 3 != 0) for i in range(50)]
    df = spark.createDataFrame(rows, "n int, fresh boolean").repartition(5)
    for most in (0, 1, 7, 33, 34, 100):
        want, done = [], 0
        for n, fresh in rows:
            if done >= most:
                break
            want.append(n)
            done += fresh
        assert sorted(r.n for r in manifest.batch_cap(df, most, "fresh", "n").collect()) == want
    assert manifest.batch_cap(df.limit(0), 3, "fresh", "n").count() == 0


def dealt(rows, n):
    groups = defaultdict(list)
    for a, b, key in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or "", r[2])):
        groups[a, b].append(key)
    groups = list(groups.values())
    picked = []
    while len(picked) < n and any(groups):
        for group in groups:
            if group and len(picked) < n:
                picked.append(group.pop(0 if len(picked) % 2 == 0 else -1))
    return list(enumerate(picked, 1))


def test_trial_sample_as_a_loop(spark):
    rows = [(["A", "B", None][i % 3], ["x", "y"][i * i % 5 % 2], f"k{i:03}") for i in range(40)] + [("C", None, "only")]
    df = spark.createDataFrame(rows, "asset_team string, parse_source string, key string").repartition(4)
    for n in (1, 6, 17, 41, 100):
        assert sorted(tuple(r) for r in manifest.trial_sample(df, n).collect()) == dealt(rows, n)
    assert manifest.trial_sample(df.limit(0), 5).count() == 0


def test_similar_as_a_loop(spark, sf):
    """The most similar name with at least the ratio; ties go to the last by code point."""
    parts = [r.p_name.lower().replace(" ", "_") for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().limit(60).collect()]
    probes = [p[:-1] + "q" for p in parts[:20]] + [p + "zz" for p in parts[20:30]]
    masters = spark.createDataFrame([("Well", p, "part", p) for p in parts], "cls string, norm string, source string, master_key string")
    asked = spark.createDataFrame([("Well", p, p) for p in set(probes)], "cls string, key string, probe string")
    for cutoff in (0.8, 0.95):
        want = {}
        for p in set(probes):
            scored = [(difflib.SequenceMatcher(None, p, m, autojunk=True).ratio(), difflib.SequenceMatcher(None, m, p, autojunk=True).ratio(), m) for m in parts]
            best = max(((a, m) for a, b, m in scored), default=None)
            either = max(((b, m) for a, b, m in scored), default=None)
            want[p] = {x[1] for x in (best, either) if x and x[0] >= cutoff}
        got = {r.key: r.nearest for r in entity.similar(asked, masters, cutoff).collect()}
        assert set(got) <= {p for p, m in want.items() if m} and all(got[p] in want[p] for p in got)
        assert {p for p, m in want.items() if len(m) == 1} - set(got) == set() or cutoff == 0.8


def test_neighbours_and_provenance(spark):
    edges = spark.createDataFrame([("a", "b", "l", '{"s": "s3key:x.pdf"}'), ("b", "c", "l", '["s3key:y.pdf", "s3key:y.pdf", "s3key:"]')], "source string, target string, label string, properties string")
    assert {(r.source, r.key) for r in graph.provenance(edges).collect()} == {("a", "x.pdf"), ("b", "y.pdf")}
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.hop) for r in graph.neighbours(edges, start, 2).where(F.col("hop") > 0).collect()} == {("b", 1), ("c", 2)}
