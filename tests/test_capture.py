import time

import pytest
from pyspark.sql import functions as F

from dossier.functions import embed
from dossier.operators.capture import Unparseable, at_most, captured
from dossier.sources.store import Store

from .test_store import ledger, run


def parse(key, content):
    if b"raise" in content:
        raise OSError("disk " * 1000)
    if b"never" in content:
        raise Unparseable("encrypted")
    if b"slow" in content:
        while True:
            time.sleep(0.01)
    if b"shape" in content:
        return [{"page_num": "not a number", "text": 3}]
    if b"blank" in content:
        return []
    return {"pages": [{"page_num": 1, "text": content.decode(), "screenshot": None, "width": 1, "height": 2}], "figures": [{"page_num": 1, "kind": "chart", "image": b"x"}]}


def test_each_failure_is_its_own_row(spark):
    contents = {"a": b"good", "b": b"raise", "c": b"never", "d": b"slow", "e": b"shape", "f": b"blank", "g": b"x" * 2000, "h": None, "i": b"good too"}
    rows = spark.createDataFrame([(k, k, None if v is None else bytearray(v)) for k, v in contents.items()], "key string, doc_id string, content binary").coalesce(1)
    got = {r.key: r for r in captured(parse, most_bytes=1000, seconds=0.3)(rows).collect()}
    assert set(got) == set(contents)
    assert {k: (r.ok, r.retriable) for k, r in got.items()} == {"a": (True, False), "b": (False, True), "c": (False, False), "d": (False, True), "e": (False, True), "f": (False, False), "g": (False, False), "h": (False, True), "i": (True, False)}
    assert got["b"].reason.startswith("OSError: disk") and len(got["b"].reason) == 500 and got["c"].reason == "encrypted" and "more than 0.3 s" in got["d"].reason and "2000 bytes" in got["g"].reason
    assert got["a"].pages[0].text == "good" and got["i"].figures[0].kind == "chart" and got["b"].pages is None
    assert captured(parse)(rows.limit(0)).count() == 0


def test_a_pass_goes_on(spark, tmp_path):
    """One document's exception fails that row only, is tried again, and what can't be parsed is skipped."""
    store = Store(spark, f"file://{tmp_path}/s")
    files = [(f"A/{n}.pdf", "1") for n in ("good", "raise", "never")]
    r = run(store, files, {k: k.encode() for k, _ in files}, parse_binary=captured(parse))
    assert (r.complete, r.failed, r.skipped) == (1, 1, 1)
    rows = ledger(store)
    assert rows["A/raise.pdf"].checksum == "" and rows["A/raise.pdf"].reason.startswith("OSError") and rows["A/never.pdf"].reason == "encrypted" and rows["A/good.pdf"].asset_count == 1
    r = run(store, files, {"A/raise.pdf": b"mended"}, parse_binary=captured(parse))
    assert (r.complete, r.unchanged) == (1, 2) and store.table("pages").count() == 2


def test_time_limits_end():
    with pytest.raises(TimeoutError), at_most(0.05):
        time.sleep(5)
    with at_most(None):
        pass
    time.sleep(0.1)


def test_embedder_batches_and_positions(spark):
    """200 texts are 96, 96 and 8, once loaded; answers come back in another order; texts are cut, empty ones a space."""

    def load():
        sizes = []

        def model(texts):
            sizes.append(len(texts))
            return [(i, [len(t), ord(t[0]), len(sizes), sizes[-1]]) for i, t in reversed(list(enumerate(texts)))]

        return model

    rows = spark.range(200).select("id", F.when(F.col("id") == 3, "").when(F.col("id") == 4, F.lit(None)).when(F.col("id") == 5, F.repeat(F.lit("x"), 9000)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).coalesce(1)
    got = {r.id: list(r.v) for r in rows.select("id", embed.model_embedder(load)(F.col("text")).alias("v")).collect()}
    assert len(got) == 200 and [got[i][0] for i in (0, 3, 4, 5, 150)] == [2, 1, 1, 8000, 4] and got[3][1] == got[4][1] == 32
    assert {(v[2], v[3]) for v in got.values()} == {(1, 96), (2, 96), (3, 8)}


def test_embedder_tries_again():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        if len(calls) == 2:
            return [(0, [1.0])]
        return [(1, [2.0]), (0, [1.0])]

    assert embed.embed_batch(model, ["a", "b"], retries=2, wait_seconds=0) == [[1.0], [2.0]] and len(calls) == 3
    calls.clear()
    with pytest.raises(ValueError, match="2 texts"):
        embed.embed_batch(model, ["a", "b"], retries=1, wait_seconds=0)
