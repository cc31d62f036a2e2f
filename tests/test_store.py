import pytest
from pyspark.sql import functions as F

from dossier.functions.embed import hash_embedder
from dossier.operators.ingest import dry_run, ingest
from dossier.sources.store import Store

LISTING = "key string, asset_team string, etag string"


def run(store, files, fetched, **options):
    spark = store.spark
    listing = spark.createDataFrame([(k, k.split("/")[0], e) for k, e in files], LISTING)
    contents = spark.createDataFrame([(k, bytearray(v)) for k, v in fetched.items()], "key string, content binary")
    return ingest(store, listing, contents, "2026-01-01T00:00:00", hash_embedder(4), **options)


def ledger(store):
    return {r.s3key: r for r in store.table("ledger").collect()}


def test_pass_and_rerun(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    files, fetched = [("A/a.las", ""), ("A/b.xlsx", ""), ("A/gone.las", "")], {"A/a.las": b"depth 1 2 3 " * 200}
    r = run(store, files, fetched)
    assert (r.complete, r.skipped, r.failed, r.requested) == (1, 1, 1, 3)
    rows = ledger(store)
    assert rows["A/a.las"].chunk_count == store.table("chunks").count() == 3
    assert rows["A/gone.las"].checksum == "" and rows["A/b.xlsx"].checksum == ""
    r = run(store, files, fetched)
    assert (r.unchanged, r.complete, r.skipped) == (1, 0, 1)  # a skip without etag is recorded each time
    # a failed fetch removes what was there
    run(store, [("A/a.las", "other")], {})
    assert store.table("chunks").count() == 0 and ledger(store)["A/a.las"].status == "failed"


def test_keep_last_good(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    run(store, [("A/a.las", "1")], {"A/a.las": b"abc"})
    run(store, [("A/a.las", "2")], {}, keep_last_good=True)
    assert store.table("chunks").count() == 1 and ledger(store)["A/a.las"].status == "complete"


def test_cap_blank_and_etag(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    files = [(f"A/{n}.las", "e1") for n in "abc"]
    fetched = {f"A/{n}.las": b"text" for n in "abc"}
    r = run(store, files, fetched, max_new=2)
    assert (r.complete, r.stopped_early) == (2, True)
    r = run(store, files, fetched, max_new=2)
    assert (r.complete, r.unchanged, r.stopped_early) == (1, 2, False)
    assert ledger(store)["A/a.las"].checksum == "etag:e1"
    r = run(store, [("A/d.txt", "")], {"A/d.txt": b"  \n"})
    assert r.failed == 1 and ledger(store)["A/d.txt"].checksum == ""
    assert run(store, [("A/d.txt", "")], {"A/d.txt": b"now"}).complete == 1


def test_orphans(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    run(store, [("A/a.las", "1")], {"A/a.las": b"abc"})
    store.commit({"ledger": store.table("ledger").limit(0)}, replaces=("ledger",))
    r = run(store, [("A/a.las", "1")], {"A/a.las": b"abc"})
    assert (r.reconciled, r.complete) == (1, 1) and store.table("documents").count() == 1


def test_versions_and_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.publish(f"file://{tmp_path}/snap", "t1")
    run(store, [("A/a.las", "1")], {"A/a.las": b"abc"})
    seen = store.table("chunks")
    run(store, [("A/b.las", "1")], {"A/b.las": b"xyz"})
    assert seen.count() == 1  # a reader keeps its version
    assert store.publish(f"file://{tmp_path}/snap", "t1")["files"] > 0
    store.optimize()
    assert store.table("chunks").count() == 2
    other = Store.restore(spark, f"file://{tmp_path}/snap", "t1", f"file://{tmp_path}/r")
    assert other.table("chunks").count() == 2 and Store.summary(spark, f"file://{tmp_path}/snap", "t1")["rows"]["chunks"] == 2
    with pytest.raises(ValueError):
        Store.restore(spark, f"file://{tmp_path}/snap", "t2", f"file://{tmp_path}/r2")


def test_dry_run(spark):
    listing = spark.createDataFrame([("a.las", "A", None), ("b.xlsx", "A", None), ("c.zip", "A", None)], LISTING)
    assert {r.gate: r.n for r in dry_run(listing).collect()} == {"text": 1, "skip": 2}


def test_stream(spark, tmp_path):
    from dossier.sources.files import listing
    from dossier.streaming.ingest import latest_status, stream_ingest

    (tmp_path / "in/T").mkdir(parents=True)
    (tmp_path / "in/T/a.txt").write_text("some words")
    (tmp_path / "in/T/b.csv").write_text("x,y")
    store = Store(spark, f"file://{tmp_path}/s")
    q = stream_ingest(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp", lambda: "2026", hash_embedder(4), files_per_batch=1)
    q.awaitTermination(120)
    assert {k: r.status for k, r in ledger(store).items()} == {"T/a.txt": "complete", "T/b.csv": "complete"}
    assert {r.key for r in listing(spark, f"file://{tmp_path}/in").collect()} == {"T/a.txt", "T/b.csv"}
    events = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, at int, status string")
    assert latest_status(events, "key", "at").first().status == "b"
    assert events.select(F.max("at")).first()[0] == 2


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    """Neither before the pointer is written nor half way through it; and its folders are never used again."""
    store = Store(spark, f"file://{tmp_path}/s")
    run(store, [("A/a.las", "1")], {"A/a.las": b"abc"})
    before, rows = store.current(), store.table("documents").collect()
    put, store.pointers.put = store.pointers.put, lambda *_: (_ for _ in ()).throw(OSError("died"))
    with pytest.raises(OSError):
        store.replace(store.table("documents").select("doc_id"), {"documents": store.table("documents")})
    store.pointers.put = put
    assert store.current() == before and store.table("documents").collect() == rows
    # half of a pointer is never under a number, only beside
    (tmp_path / "s/versions/_half").write_text('{"tables": [1')
    assert store.current() == before
    assert not store.pointers.put(before.number, {}) and store.current() == before
    run(store, [("A/b.las", "1")], {"A/b.las": b"xyz"})
    assert store.table("documents").count() == 2 and store.current().number == before.number + 1
    # the dead writer's folders go when they are old enough, what versions name stays
    assert store.vacuum(3600) == 0 and store.vacuum(0) >= 3 and store.vacuum(0) == 0
    assert store.table("documents").count() == 2 and {r.text for r in store.table("chunks").collect()} == {"abc", "xyz"}


def test_a_pass_writes_what_it_adds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    run(store, [(f"A/{i}.las", "1") for i in range(60)], {f"A/{i}.las": f"words {i} ".encode() * 3000 for i in range(60)})
    size = lambda n: store._bytes("chunks", [n])
    first = store.current().folders("chunks")[-1]
    run(store, [("A/3.las", "2")], {"A/3.las": b"new words"})
    last = store.current().folders("chunks")[-1]
    assert last != first and size(last) < size(first) / 5
    texts = [r.text for r in store.table("chunks").where("s3key = 'A/3.las'").collect()]
    assert texts == ["new words"] and store.table("documents").count() == 60
    n = {r.table: r.n for r in store.counts().collect()}
    store.optimize()
    assert len(store.current().folders("chunks")) == 1 and store.versions() == [store.current().number] and {r.table: r.n for r in store.counts().collect()} == n


def test_stored_terms_give_the_same_search(spark, tmp_path):
    from dossier.operators import retrieval

    store = Store(spark, f"file://{tmp_path}/s")
    texts = {"A/a.txt": "stuck pipe and more pipe", "A/b.txt": "pipe; Stuck STUCK stuck", "B/c.txt": "nothing of it", "B/d.txt": "über-pipe 3 of 4"}
    run(store, [(k, "1") for k in texts], {k: v.encode() for k, v in texts.items()})
    t = store.tables()
    for query, team in (("stuck PIPE", None), ("of pipe, pipe", "B"), ("absent", None), ("?", None)):
        raw = [(r.chunk_id, round(r.score, 9)) for r in retrieval.bm25(t["chunks"], query, 5, asset_team=team).collect()]
        assert raw == [(r.chunk_id, round(r.score, 9)) for r in retrieval.bm25_stored(t["chunks"], t["terms"], query, 5, asset_team=team).collect()]
    assert [r.asset_team for r in retrieval.search(t, "stuck pipe", "fts", 3, None).collect()][:2] == ["A", "A"]


def test_screenshots_figures_and_blank_pages(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    pages = "array(named_struct('page_num', 1, 'text', '', 'screenshot', X'0102', 'width', 2, 'height', 1), named_struct('page_num', 2, 'text', 'words', 'screenshot', CAST(null AS binary), 'width', 2, 'height', 1))"
    figures = "array(named_struct('page_num', 2, 'kind', 'chart', 'image', X'03'))"
    parse = lambda rows: rows.selectExpr("doc_id", "true AS ok", "false AS retriable", "'' AS reason", f"{pages} AS pages", f"{figures} AS figures")
    image = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    r = run(store, [("A/a.pdf", "1"), ("A/gone.txt", "1")], {"A/a.pdf": b"%PDF"}, parse_binary=parse, embed_image=image)
    assert (r.complete, r.failed) == (1, 1) and [tuple(x) for x in r.failures.collect()] == [("A/gone.txt", "fetch failed")]
    rows = {p.page_num: p for p in store.table("pages").collect()}
    assert list(rows[1].vector) == [0.0] * 4 and any(rows[2].vector)
    assert list(rows[1].clip_vector) == [2.0, 1.0] and not any(rows[2].clip_vector)
    asset = store.table("assets").first()
    assert (asset.kind, list(asset.clip_vector), asset.page_id) == ("chart", [1.0, 1.0], rows[2].page_id) and store.table("ledger").where("status = 'complete'").first().asset_count == 1
