import json
import os

import numpy as np
import pytest

from dossier.operators import cells, retrieval
from dossier.sources import objects


def test_cells_equal_the_scan(spark):
    rng = np.random.default_rng(0)
    middle = rng.standard_normal((30, 16)) * 4
    rows = [(i, (middle[i % 30] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(15)] + [(4000, None)]  # ties, and a null
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(4)
    made = cells.build(df, pivots=32)
    assert sum(n for n, _, _ in made.ranges.values()) == 3015
    read = []
    for q in [rows[7][1], rows[29][1], [0.0] * 16, (middle[3] + 20).tolist()]:
        for k in (1, 20):
            want = [(r.chunk_id, r.distance) for r in retrieval.nearest(df, q, k).select("chunk_id", "distance").collect()]
            assert [tuple(r) for r in made.nearest(q, k).collect()] == want
            read.append(len(made.read))
    assert read[0] <= 8 and read[1] <= 16
    assert made.nearest(rows[0][1], 5000).count() == 3015 and made.nearest(rows[0][1], 0).count() == 0
    assert cells.build(df.where("vector IS NULL")).nearest([0.0] * 16, 3).count() == 0


class Folder:
    """An object store in a folder, two objects a page; etags are quoted and each prefix has a placeholder."""

    def __init__(self, root):
        self.root = root

    def list(self, prefix, token):
        keys = sorted(f"{os.path.relpath(d, self.root)}/{f}".removeprefix("./") for d, _, files in os.walk(self.root) for f in files)
        keys = [k for k in keys if k.startswith(prefix) and (token is None or k > token)]
        found = [{"key": k, "etag": f'"{os.path.getsize(f"{self.root}/{k}")}"', "size": os.path.getsize(f"{self.root}/{k}"), "content_type": "text/plain" if k.endswith("txt") else None, "modified": os.path.getmtime(f"{self.root}/{k}")} for k in keys[:2]]
        if token is None:
            found.insert(0, {"key": f"{prefix}folder/", "size": 0})
        return found, keys[1] if len(keys) > 2 else None

    def put(self, key, content, content_type):
        os.makedirs(os.path.dirname(f"{self.root}/{key}"), exist_ok=True)
        with open(f"{self.root}/{key}", "wb") as out:
            out.write(content)


@pytest.fixture()
def store(spark, tmp_path):
    root = str(tmp_path / "o")
    for k in ("A/1.txt", "A/2.txt", "A/3.bin", "A/4.txt", "A/5.txt", "B/1.txt", "C/x.txt"):
        Folder(root).put(k, k.encode() * 3, None)
    spark.dataSource.register(objects.object_store(lambda: Folder(root), "folder_objects"))
    return root


def test_listing(spark, store):
    rows = spark.read.format("folder_objects").option("prefixes", json.dumps(["A/", "B/", "A/1"])).load()
    got = {r.key: r for r in rows.collect()}
    assert sorted(got) == ["A/1.txt", "A/2.txt", "A/3.bin", "A/4.txt", "A/5.txt", "B/1.txt"] and rows.count() == 6 and rows.rdd.getNumPartitions() == 2
    assert (got["A/1.txt"].etag, got["A/1.txt"].asset_team, got["A/1.txt"].content_type, got["A/3.bin"].content_type) == ("21", "A", "text/plain", objects.BINARY_TYPE)
    assert spark.read.format("folder_objects").load().count() == 7
    assert [objects.unquoted(x) for x in ('"a"', 'W/"a"', "a", None)] == ["a", "a", "a", ""]
    with pytest.raises(ValueError, match="comes back"):
        list(objects.pages(type("Loop", (), {"list": lambda self, prefix, token: ([], "t")})(), ""))


def test_one_object_a_key(spark, store):
    rows = spark.createDataFrame([(f"cache/{i}.json", bytearray(json.dumps({"i": i}).encode()), objects.JSON_TYPE) for i in range(20)], objects.OBJECTS)
    for _ in range(2):  # again: the same objects
        rows.repartition(3).write.format("folder_objects").mode("append").save()
    assert spark.read.format("folder_objects").option("prefixes", '["cache/"]').load().count() == 20
    with open(f"{store}/cache/7.json") as f:
        assert json.load(f) == {"i": 7}
    with pytest.raises(Exception, match="objects are written from"):
        rows.select("key").write.format("folder_objects").mode("append").save()


def test_stream(spark, store, tmp_path):
    def take():
        q = spark.readStream.format("folder_objects").load().writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.key for r in spark.read.parquet(f"file://{tmp_path}/out").select("key").collect())

    assert len(take()) == 7
    Folder(store).put("D/new.txt", b"new", None)
    os.utime(f"{store}/D/new.txt", (4e9, 4e9))
    assert take()[-1] == "D/new.txt" and len(take()) == 8
