"""Commits of several writers, point reads by the index of keys, incremental reconciling, and searches over blocks of postings."""

import itertools

import pytest
from pyspark.sql import functions as F

from dossier.operators import postings, retrieval
from dossier.sources import keyindex
from dossier.sources.store import Conflict, Store

from .test_store import ledger, run


def facts(spark, *ids):
    rows = [(i, i, "T", "text", 1) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id string, s3key string, asset_team string, format_gate string, page_count int")
    entry = docs.selectExpr("doc_id", "s3key", "'c' AS checksum", "'complete' AS status", "'' AS reason", "1 AS page_count", "0 AS chunk_count", "0 AS asset_count", "'now' AS updated_at")
    return {"documents": docs, "ledger": entry}


def ids_of(store, name="documents"):
    return sorted(r.doc_id for r in store.table(name).select("doc_id").collect())


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """Stores with documents a and b, each at a root of its own."""
    made = itertools.count()

    def new():
        store = Store(spark, f"file://{tmp_path_factory.mktemp('commits')}/s{next(made)}")
        store.commit(facts(spark, "a", "b"))
        return store

    return new


@pytest.mark.parametrize("first", [0, 1])
def test_two_writers_both_land(spark, bare, first):
    """Both have written their folders before either lands; whichever lands first, nothing of the other is lost."""
    store = bare()
    one = store.change().write(facts(spark, "c"), deleted=spark.createDataFrame([("a",)], "doc_id string"))
    other = store.change().write(facts(spark, "d"), deleted=spark.createDataFrame([("b",)], "doc_id string"))
    versions = [w.land().number for w in ((one, other) if first == 0 else (other, one))]
    assert versions == [2, 3] == store.versions()[1:] and ids_of(store) == ids_of(store, "ledger") == ["c", "d"]


@pytest.mark.parametrize("first", [0, 1])
def test_two_writers_of_a_document(spark, bare, first):
    """The second raises, and nothing of it is seen; from the latest version it can do it again."""
    store = bare()
    gone = spark.createDataFrame([("a",)], "doc_id string")
    writers = [store.change().write({**facts(spark, "a"), "documents": facts(spark, "a")["documents"].withColumn("s3key", F.lit(k))}, deleted=gone) for k in ("one", "two")]
    early, late = writers if first == 0 else writers[::-1]
    early.land()
    with pytest.raises(Conflict, match="a"):
        late.land()
    assert store.table("documents").where("doc_id = 'a'").first().s3key == ("one", "two")[first] and ids_of(store) == ["a", "b"]
    store.commit(facts(spark, "a"), deleted=gone)
    assert ids_of(store) == ["a", "b"]


def test_more_writers_in_every_order(spark, bare):
    """Three writers, of which two touch one document: of these the first that lands stays."""
    sets = {"x": ("c",), "y": ("c", "d"), "z": ("e",)}
    for order in itertools.permutations(sets):
        store = bare()
        writers = {n: store.change().write(facts(spark, *ids)) for n, ids in sets.items()}
        lost = []
        for n in order:
            try:
                writers[n].land()
            except Conflict:
                lost.append(n)
        assert lost == [[n for n in order if n in "xy"][1]]
        assert ids_of(store) == sorted(["a", "b", *(i for n in order if n not in lost for i in sets[n])])


def test_a_dead_writer_between_two(spark, bare):
    """One has written and never lands, one has died while its pointer was beside; others go on, and vacuum only takes old folders."""
    store = bare()
    dead = store.change().write(facts(spark, "c"))
    slow = store.change().write(facts(spark, "d"))
    store.commit(facts(spark, "e"))
    assert store.vacuum(3600) == 0
    slow.land()
    assert ids_of(store) == ["a", "b", "d", "e"] and store.vacuum(0) >= 3 and ids_of(store) == ["a", "b", "d", "e"]
    dead.added.clear()
    assert store.versions() == [1, 2, 3]


def test_anew_and_merging_meet_commits(spark, bare):
    store = bare()
    late = store.change().write(facts(spark, "c"))
    store.commit({"ledger": facts(spark, "a")["ledger"]}, replaces=("ledger",))
    with pytest.raises(Conflict, match="anew"):
        late.land()
    # a merge of version 2 goes below what lands meanwhile, whose deletions still hold for what was merged
    put = store.pointers.put
    meanwhile = [lambda: Store(spark, store.root).commit(facts(spark, "f"), deleted=spark.createDataFrame([("a",)], "doc_id string"))]
    store.pointers.put = lambda n, c: (meanwhile.pop()() if meanwhile else None, put(n, c))[1]
    store.optimize()
    assert ids_of(store) == ["b", "f"] and len(store.current().folders("documents")) == 2 and store.versions() == [store.current().number]
    with pytest.raises(Conflict, match="removed"):
        Store(spark, store.root).change(base=store.current().__class__(1)).write(facts(spark, "g")).land()


def files_read(df):
    return {f for f in df.inputFiles() if "/index/" not in f}


def test_point_reads_open_one_file(spark, tmp_path):
    """Some 200 files in two commits: a page, and a document's pages, are read from the one file that has them."""
    store = Store(spark, f"file://{tmp_path}/s")
    pages = spark.range(4000).selectExpr("concat('d', lpad(string(id div 4), 4, '0'), ':p', id % 4) AS page_id", "concat('d', lpad(string(id div 4), 4, '0')) AS doc_id", "'k' AS s3key", "'T' AS asset_team", "concat('page ', id) AS text", "int(id % 4) AS page_num", "0 AS width", "0 AS height", "array(float(0)) AS vector", "array(float(0)) AS clip_vector", "false AS has_screenshot")
    for part in (0, 1):
        store.commit({"pages": pages.where(f"crc32(doc_id) % 2 = {part}").repartition(100, "doc_id")})
    folders = store.current().folders("pages")
    assert sum(n.endswith(".parquet") for f in folders for n in store._names(f"pages/v={f}")) > 190
    for doc in ("d0000", "d0123", "d0999"):
        one, all_of_it = store.rows_with("pages", "page_id", f"{doc}:p2"), store.rows_with("pages", "doc_id", doc)
        assert len(files_read(one)) == len(files_read(all_of_it)) == 1
        assert [r.text for r in one.collect()] == [f"page {int(doc[1:]) * 4 + 2}"]
        assert sorted(r.page_num for r in retrieval.get_document_pages(all_of_it, doc).collect()) == [0, 1, 2, 3]
    assert store.rows_with("pages", "page_id", "d0123:p9").count() == 0 and store.rows_with("assets", "doc_id", "d0001").count() == 0
    # many keys at once, and a deletion
    some = spark.createDataFrame([("d0001",), ("d0500",), ("nowhere",), (None,)], "doc_id string")
    assert {r.doc_id for r in store.rows_of("pages", some).collect()} == {"d0001", "d0500"} and len(files_read(store.rows_of("pages", some))) == 2
    store.commit({}, deleted=spark.createDataFrame([("d0123",)], "doc_id string"))
    assert store.rows_with("pages", "page_id", "d0123:p2").count() == store.rows_with("pages", "doc_id", "d0123").count() == 0 and store.rows_with("pages", "doc_id", "d0124").count() == 4
    store.optimize(file_bytes=4000)
    assert len(files_read(store.rows_with("pages", "doc_id", "d0124"))) == 1 and store.rows_with("pages", "doc_id", "d0124").count() == 4


def test_filters_never_miss(spark, tmp_path):
    """Large filters of many blocks, and null keys: every key is found in its file, few others are."""
    rows = spark.range(20000).selectExpr("IF(id % 100 = 7, NULL, sha1(string(id))) AS key", "id").repartition(3)
    rows.write.parquet(f"file://{tmp_path}/t")
    there = spark.read.parquet(f"file://{tmp_path}/t")
    index = keyindex.build({"t": (there, ("key",))}, "f").cache()
    assert index.agg(F.max("blocks")).first()[0] >= 16
    keys = there.select("key", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    for r in keys.where("id % 4000 = 1").collect():
        assert r.file in {x.file for x in keyindex.files_with(index, "t", "key", r.key).collect()}
    wrong = [keyindex.files_with(index, "t", "key", f"{i:040x}").count() for i in range(40)]
    assert sum(wrong) <= 2
    assert keyindex.files_with_any(index, "t", "key", there.select("key")).count() == 3


def test_reconcile_reads_what_was_added(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    run(store, [(f"A/{i}.las", "1") for i in range(30)], {f"A/{i}.las": b"words" for i in range(30)})
    assert store.reconcile() == 0
    run(store, [("A/x.las", "1")], {"A/x.las": b"words"})
    version = store.current()
    # only the set of the last commit is left to be read
    read = store.unchecked_orphans(version).inputFiles()
    assert len(version.unchecked) == 1 and read and all(f"/keys/v={version.unchecked[0][0]}/" in f for f in read)
    # rows without a ledger row, of a new document and of one that has one
    store.commit({"documents": facts(spark, "lost")["documents"]})
    known = store.table("ledger").first().doc_id
    store.commit({"documents": facts(spark, known)["documents"]})
    assert {r.doc_id for r in store.unchecked_orphans(store.current()).collect()} == {"lost"} == {r.doc_id for r in store.orphans().collect()}
    assert store.reconcile() == 1 and store.orphans().count() == 0 and store.reconcile() == 0
    assert store.current().unchecked and len(store.current().unchecked) == 1
    # a ledger that starts anew leaves all documents to be checked
    store.commit({"ledger": store.table("ledger").limit(0)}, replaces=("ledger",))
    assert store.current().unchecked is None and store.reconcile() == 31 and store.table("documents").count() == 0


TEXTS = {"A/a.txt": "stuck pipe and more pipe", "A/b.txt": "pipe; Stuck STUCK stuck", "B/c.txt": "nothing of it", "B/d.txt": "über-pipe 3 of 4", "B/e.txt": "ΟΔΟΣ road, Straße", "B/f.txt": "İstanbul ﬁsh road"}


def test_all_ways_of_bm25_agree(spark, tmp_path):
    """Unstored texts, a term table and blocks; also on letters whose case is no simple matter, and after documents have changed."""
    store = Store(spark, f"file://{tmp_path}/s")

    def same(query, team=None, limit=5):
        t = store.tables()
        ways = [retrieval.bm25(t["chunks"], query, limit, asset_team=team), retrieval.bm25_stored(t["chunks"], t["terms"], query, limit, asset_team=team), retrieval.bm25_blockmax(t, query, limit, team)]
        got = [[(r.chunk_id, round(r.score, 9)) for r in w.collect()] for w in ways]
        assert got[0] == got[1] == got[2], (query, got)
        return got[0]

    run(store, [(k, "1") for k in TEXTS], {k: v.encode() for k, v in TEXTS.items()})
    assert [len(same(q, t)) for q, t in (("stuck PIPE", None), ("of pipe, pipe", "B"), ("absent", None), ("?", None), ("road", "B"))] == [3, 2, 0, 0, 2]
    assert [len(same(q)) for q in ("ΟΔΟΣ", "οδος", "İstanbul", "STRASSE", "straße", "ﬁsh", "ÜBER")] == [1, 1, 1, 0, 1, 1, 1]
    run(store, [("A/a.txt", "2"), ("B/g.txt", "1")], {"A/a.txt": b"road only", "B/g.txt": b"pipe pipe stuck"})
    assert len(same("stuck pipe")) == 3 and len(same("road")) == 3
    sums = lambda: (store.table("lengths").agg(F.sum("n"), F.sum("total")).first()[:], {r.term: r.n for r in postings.summed(store.table("frequencies"), "frequencies").groupBy("term").agg(F.sum("n").alias("n")).collect()})
    chunks = store.table("chunks")
    want = (chunks.agg(F.count("*"), F.sum("n_terms")).first()[:], {r.term: r["count"] for r in postings.term_table(chunks, "chunk_id").groupBy("term").count().collect()})
    assert sums() == want
    store.optimize()
    assert sums() == want and len(same("stuck pipe")) == 3 and len(store.current().folders("lengths")) == 1
    assert [r.asset_team for r in retrieval.search(store.tables(), "stuck pipe", "fts", 3, None).collect()][0] == "A"


def test_blocks_leave_most_postings_out(spark):
    """Few chunks have a rare term often: only tiles that can reach them are read, and the result is the full one."""
    text = F.concat_ws(" ", F.expr("transform(sequence(1, 30), k -> concat('w', pmod(hash(id, k), 300)))"), F.when(F.col("id") % 397 == 5, F.lit("w7 w7 rare rare")).otherwise(F.lit("")))
    chunks = spark.range(8000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.format_string("d%04d", F.expr("id div 5")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "T").alias("asset_team"), text.alias("text"))
    chunks = chunks.withColumn("n_terms", F.size(postings.terms(F.col("text")))).cache()
    rows = postings.term_table(chunks, "chunk_id", "doc_id", "asset_team")
    made = postings.blocks(rows, tile=16).withColumn("v", F.lit(1)).cache()
    tables = {"postings": made, "lengths": postings.lengths(chunks), "frequencies": postings.frequencies(rows)}
    for query, team in (("w7 rare", None), ("w7 w9 rare", "T"), ("w1", None)):
        s = postings.Search(tables, query, team)
        got = [(r.chunk_id, round(r.score, 9)) for r in s.top(5).collect()]
        assert got == [(r.chunk_id, round(r.score, 9)) for r in retrieval.bm25(chunks, query, 5, asset_team=team).collect()]
        if query != "w1":
            assert s.worth_reading(5).agg(F.sum("n")).first()[0] < 0.4 * s.blocks.agg(F.sum("n")).first()[0]
    # bounds hold when the mean length has grown since blocks were written
    longer = {**tables, "lengths": tables["lengths"].withColumn("total", F.col("total") * 4)}
    s = postings.Search(longer, "w7 rare")
    full = s.scores(s.blocks).orderBy(F.desc("score"), "chunk_id").limit(5).collect()
    assert s.top(5).collect() == full
    assert retrieval.bm25_blockmax({**tables, "postings": made.limit(0), "lengths": tables["lengths"].limit(0), "frequencies": tables["frequencies"].limit(0)}, "w1", 3).count() == 0


def test_a_pass_starts_anew_after_a_conflict(spark, tmp_path):
    """Another writer lands the same document between a pass's reading of the ledger and its commit: the pass finds it done."""
    store = Store(spark, f"file://{tmp_path}/s")
    put = store.pointers.put
    meanwhile = [lambda: run(Store(spark, store.root), [("A/a.las", "1")], {"A/a.las": b"theirs"})]
    store.pointers.put = lambda n, c: (meanwhile.pop()() if meanwhile else None, put(n, c))[1]
    r = run(store, [("A/a.las", "1"), ("A/b.las", "1")], {"A/a.las": b"mine", "A/b.las": b"mine"})
    assert (r.complete, r.unchanged) == (1, 1) and {k: x.status for k, x in ledger(store).items()} == {"A/a.las": "complete", "A/b.las": "complete"}
    assert {r.text for r in store.table("chunks").collect()} == {"theirs", "mine"}
