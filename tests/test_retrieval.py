import pytest
from pyspark.sql import functions as F

from dossier.functions.embed import keyword_embedder
from dossier.operators import retrieval, scoring

WORDS = ["stuck", "pipe", "cement", "survey", "s733h", "casing", "mud", "plat"]


@pytest.fixture(scope="module")
def tables(spark):
    texts = [("d1", "A", "stuck pipe report. " * 5), ("d2", "A", "cement job S733H done. " * 5), ("d3", "B", "stuck mud log. " * 5), ("d4", "B", "")]
    rows = spark.createDataFrame([(f"{d}:p1", d, f"{t}/{d}.txt", t, x, 1) for d, t, x in texts], "page_id string, doc_id string, s3key string, asset_team string, text string, page_num int")
    image = F.when(F.col("doc_id") == "d4", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))).cast("array<float>")
    vector = F.when(F.col("text") == "", F.array_repeat(F.lit(0.0).cast("float"), 8)).otherwise(keyword_embedder(WORDS)(F.col("text")))
    pages = rows.withColumns({"vector": vector, "clip_vector": image, "has_screenshot": F.col("doc_id") == "d4"})
    chunks = pages.where("text <> ''").withColumn("chunk_id", F.concat("page_id", F.lit(":c0")))
    assets = pages.where("doc_id = 'd4'").withColumn("asset_id", F.concat("page_id", F.lit(":a0")))
    return {"pages": pages, "chunks": chunks, "assets": assets}


def embed(query):
    return [1.0 if w in query.lower() else 0.01 for w in WORDS]


def test_hybrid_merges_signals(tables):
    hits = retrieval.search(tables, "stuck pipe", "hybrid", 3, embed, lambda q: [1.0, 0.0]).collect()
    assert hits[0].doc_id == "d1" and len(hits[0].signals) >= 2
    assert len({h.page_id for h in hits}) == len(hits)


def test_team_is_a_prefilter(tables):
    hits = retrieval.search(tables, "stuck mud", "chunks", 5, embed, asset_team="A").collect()
    assert hits and {h.asset_team for h in hits} == {"A"}


def test_images_and_assets(tables):
    for mode in ("images", "assets"):
        assert [h.doc_id for h in retrieval.search(tables, "plat", mode, 2, embed, lambda q: [1.0, 0.0]).collect()] == ["d4"]


def test_unknown_mode(tables):
    with pytest.raises(ValueError):
        retrieval.search(tables, "x", "nearby", 3, embed)


def test_grep(tables):
    assert [r.doc_id for r in retrieval.grep(tables["pages"], "S733H").collect()] == ["d2"]
    row = retrieval.grep(tables["pages"], r"S\d{3}H", regex=True).first()
    assert row.match == "S733H" and "cement job S733H" in row.context
    assert retrieval.grep(tables["pages"], ".*").count() == 0


def test_blank_pages_beat_poor_matches(tables):
    """A zero vector is nearer than a unit vector with a cosine under a half."""
    rows = tables["pages"].limit(0).select("page_id", "asset_team", "vector")
    rows = rows.union(rows.sparkSession.createDataFrame([("blank", "A", [0.0, 0.0]), ("poor", "A", [0.3, 0.954])], "page_id string, asset_team string, vector array<float>"))
    assert [r.page_id for r in retrieval.nearest(rows, [1.0, 0.0], 2, "vector", "page_id").collect()] == ["blank", "poor"]


def test_agreement_can_win(spark):
    """Rank 2 in three signals beats rank 1 in one; in two it does not."""
    row = lambda page, signal, rank: (page, signal, rank, "t")
    lists = [spark.createDataFrame([row("one", "chunks", 1), row("three", "pages", 2), row("three", "fts", 2), row("three", "images", 2), row("two", "pages", 2), row("two", "fts", 2)], "page_id string, signal string, rank int, text string")]
    assert [r.page_id for r in retrieval.fuse(lists, 5).collect()] == ["three", "one", "two"]


def test_empty_store(tables):
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert retrieval.search(empty, "stuck", "hybrid", 3, embed, lambda q: [1.0, 0.0]).count() == 0


def test_status(spark):
    rows = [("d1", "A/a_b.las", "c", "complete", "2"), ("d2", "A/axb.las", "", "skipped", "3"), ("d3", "B/x.png", "e", "skipped", "1"), ("d4", "b/y.las", "", "failed", "9")]
    ledger = spark.createDataFrame(rows, "doc_id string, s3key string, checksum string, status string, updated_at string")
    r = retrieval.document_status(ledger, limit=2).first()
    assert (r.complete, r.skipped, r.failed, r.total_matches, r.ledger_as_of, len(r.matches)) == (1, 2, 1, 4, "9", 2)
    assert [m.will_retry for m in retrieval.document_status(ledger).first().matches] == [False, True, False, True]
    assert retrieval.document_status(ledger, name_query="a_b").first().total_matches == 1
    assert retrieval.document_status(ledger, name_query="%").first().total_matches == 0
    assert retrieval.document_status(ledger, asset_team="B/").first().total_matches == 2
    r = retrieval.document_status(ledger, status="failed").first()
    assert (r.complete, r.failed, r.ledger_as_of) == (0, 1, "9")


def test_scores(spark):
    schema = "id string, modality string, expected_pages array<struct<s3key: string, page: int>>"
    questions = spark.createDataFrame([("q1", "text", [("a", 1)]), ("q2", "figure", [("b", 1), ("b", 2)]), ("q3", "table", [("c", 1)]), ("q4", "text", [("d", 1)])], schema)
    hits = spark.createDataFrame(
        [("q1", 1, "a", 1, {"chunks": 1}), ("q2", 5, "b", 1, {"fts": 1}), ("q3", 2, "c", 1, {"assets": 1}), ("q4", 6, "d", 1, {"chunks": 1})], "id string, rank int, s3key string, page_num int, signals map<string,int>"
    )
    total = scoring.summary(scoring.score_questions(questions, hits)).where("modality IS NULL").first()
    assert (total.any_page_hit_at_5, total.page_coverage_at_5, total.modality_hit_at_5) == (0.75, 0.625, 0.5)


def test_nearest_of_each_query_in_blocks(spark):
    vectors = [(i, [float(i % 7), float(i * i % 11)]) for i in range(40)]
    rows = spark.createDataFrame([*vectors, (99, None)], "id int, v array<double>")
    queries = spark.createDataFrame([*((f"q{i}", v) for i, v in vectors[:7]), ("none", None), (None, [0.0, 0.0])], "query string, asked array<double>")
    want = set()
    for i, v in vectors[:7]:
        far = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in vectors)
        want |= {(f"q{i}", j, d, n) for n, (d, j) in enumerate(far[:3], 1)}
    for block in (1, 3, 7, 100):
        got = retrieval.nearest_each(rows, queries, 3, "v", "id", block).collect()
        assert len(got) == 21 and {(r["query"], r["id"], r["distance"], r["rank"]) for r in got} == want
    assert retrieval.nearest_each(rows, queries.limit(0), 3, "v", "id").count() == 0


def test_postings_of_texts_are_not_shuffled(spark):
    """Chunks are dealt once, by tile; their blocks are those of postings, and grouping them needs no other shuffle."""
    import re

    from dossier.operators import postings

    rows = [(f"c{i}", f"d{i // 2}", "AB"[i % 2] if i % 5 else None, " ".join(f"w{k}" for k in range(i % 13))) for i in range(200)] + [("c200", "d200", "A", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, asset_team string, text string")
    sums = postings.lengths(chunks.withColumn("n_terms", F.size(postings.terms(F.col("text")))))
    made = postings.tiled_blocks(chunks, sums, tile=16)
    assert len(re.findall(r"Exchange \w*partitioning", made._jdf.queryExecution().executedPlan().toString())) == 1
    n, total = len(rows), sum(i % 13 for i in range(200))
    want = postings.blocks(postings.term_table(chunks, "chunk_id", "doc_id", "asset_team"), tile=16, size=(n, total / n))
    assert sorted(map(repr, made.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_hits_are_read_by_their_keys(spark):
    """Hits come with their rows; what rows are joined of is filtered by the keys of the hits first."""
    rows = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(50)], "page_id string, text string").join(spark.range(40).selectExpr("concat('p', id) AS page_id"), "page_id")
    hits = spark.createDataFrame([("p3", 0.5), ("p7", 0.25), ("p45", 0.1)], "page_id string, distance double")
    got = retrieval.of_hits(hits, rows, "page_id")
    assert {(r.page_id, r.distance, r.text) for r in got.collect()} == {("p3", 0.5, "text 3"), ("p7", 0.25, "text 7")}
    assert retrieval.of_hits(hits.limit(0), rows, "page_id").count() == 0
