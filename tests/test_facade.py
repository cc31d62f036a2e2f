from pyspark.sql import functions as F

from dossier.plans import catalogue
from dossier.operators import views
from dossier.plans.facade import Tools, ViewChain, same_host


def test_tools(spark, sf):
    t = catalogue.Tables(spark, sf)
    rows = catalogue.manifest_of(t)
    pages = catalogue.pages_of(t).withColumn("doc_id", F.col("doc_id").cast("string"))
    documents = pages.select("doc_id", "s3key", "asset_team", F.lit("text").alias("format_gate"), F.lit(1).alias("page_count"))
    parsed = t.documents.select(F.concat(F.lit("k/"), F.col("doc_id").cast("string")).alias("key"), F.lit(1).alias("page"), F.col("text").alias("markdown"))
    tools = Tools(rows, {"pages": pages, "documents": documents, "ledger": catalogue.ledger_of(t)}, parsed, analyst=lambda q, files: f'ok ```{{"answer": "{len(files)}", "citations": [{{"key": "k/1"}}, 3]}}```')
    assert tools.corpus_overview()["total"] == rows.count()
    assert tools.search_documents(asset_team="src1", limit=3)["returned"] == 3
    assert "error" in tools.search_documents(limit=1000) and "error" in tools.get_document_info("nope")
    assert tools.get_document_info("k/1")["asset_team"] == "src1"
    assert tools.read_parsed_document("k/1")["pages"][0]["page"] == 1
    out = tools.delegate_analysis("q", ["k/1", "k/2", "zz"])
    assert out["answer"] == "2" and out["unknown_keys_skipped"] == ["zz"] and out["citations"] == [{"key": "k/1"}]
    assert tools.grep_evidence("the", limit=2)["matches"]
    assert tools.find_evidence_files("doc_1", limit=2)["documents"] and "error" in tools.find_evidence_files(format_gate="exe")
    assert tools.check_document_status(status="failed")["summary"]["complete"] == 0
    assert "error" in tools.read_evidence() and "error" in tools.read_evidence(page_id="none") and "error" in tools.search_evidence("x", mode="bad")


def test_graph_tool(spark):
    nodes = spark.createDataFrame([("1", "E", "Big Well"), ("2", "E", "Acme")], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "2", "drilled_by", '{"t":["s3key:a.pdf","doc_id:d1"]}')], "source string, target string, label string, properties string")
    out = Tools(nodes=nodes, edges=edges).query_knowledge_graph("who drilled big well", ["big well"])
    assert out["sources"] == ["a.pdf"] and out["evidence_doc_ids"] == ["d1"] and out["mode"] == "graph"
    chunks = spark.createDataFrame([("d2:p1:c0", "d2:p1", "d2", "b.pdf", "A", "nobody drilled it", 1)], "chunk_id string, page_id string, doc_id string, s3key string, asset_team string, text string, page_num int")
    pages = chunks.drop("chunk_id")
    asked = Tools(nodes=nodes, edges=edges.limit(0), evidence={"chunks": chunks, "pages": pages}).query_knowledge_graph("who drilled this")
    assert (asked["sources"], asked["evidence_doc_ids"], asked["mode"]) == (["b.pdf"], ["d2"], "chunks")


def test_object_facts(spark):
    rows = spark.createDataFrame([("a.pdf", "A")], "key string, asset_team string")
    tools = Tools(rows, objects=spark.createDataFrame([("a.pdf", 12, "e1")], "key string, size long, etag string"))
    assert tools.get_document_info("a.pdf")["object"] == {"size": 12, "etag": "e1"}


def test_hosts():
    assert same_host("https://a.example/x", "https://a.example") and not same_host("https://a.example.evil/x", "https://a.example")


def test_parsed_documents_come_from_a_chain(spark):
    """Reference, then cache, then a parse that the next call finds in the cache; an extraction has fields with citations."""
    import json

    rows = spark.createDataFrame([(k, "A") for k in ("run.pdf", "fields.pdf", "fresh.pdf", "broken.pdf")], "key string, asset_team string")
    bodies = {
        "run.pdf": {"output": {"chunks": [{"content": "first"}, {"content": "second", "metadata": {"pageRange": {"start": 4}}}]}},
        "fields.pdf": {"output": {"value": {"depth": 12, "name": "x"}, "metadata": {"depth": {"citations": [{"page": {"number": 2}}, {}]}}}},
    }
    view = lambda some: views.normalize(spark.createDataFrame([(k, json.dumps(v)) for k, v in some.items()], "key string, json string"))
    cache: dict = {}
    parsed: list = []

    def parse(keys):
        found = [r.key for r in keys.collect() if r.key != "broken.pdf"]
        parsed.extend(found)
        return view({k: {"kind": "markdown", "pages": [{"page": 1, "markdown": f"parsed {k}"}], "pageCount": 1} for k in found})

    def keep(fresh):
        cache.update({r.key: {"kind": r.kind, "pages": [p.asDict() for p in r.pages], "pageCount": r.page_count} for r in fresh.collect()})

    tools = Tools(rows, chain=ViewChain(view(bodies), lambda: view(cache), parse, keep))
    out = tools.read_parsed_document("run.pdf")
    assert (out["source"], [(p["page"], p["markdown"]) for p in out["pages"]]) == ("manifest", [(1, "first"), (4, "second")]) and "fields" not in out
    assert [p["page"] for p in tools.read_parsed_document("run.pdf", page_start=2)["pages"]] == [4]
    out = tools.read_parsed_document("fields.pdf")
    assert (out["kind"], out["fields"], out["field_pages"], out["pages"]) == ("extraction", {"depth": 12, "name": "x"}, {"depth": [2]}, [])
    assert [tools.read_parsed_document("fresh.pdf")["source"] for _ in range(2)] == ["parsed", "cache"] and parsed == ["fresh.pdf"]
    assert "can't be parsed" in tools.read_parsed_document("broken.pdf")["error"] and "error" in tools.read_parsed_document("unknown.pdf")


def test_evidence_is_read_by_the_stores_index(spark, tmp_path):
    from dossier.sources.store import Store

    from .test_store import run

    store = Store(spark, f"file://{tmp_path}/s")
    run(store, [(f"A/{i}.txt", "1") for i in range(5)], {f"A/{i}.txt": f"text {i}".encode() for i in range(5)})
    page = store.table("pages").where("text = 'text 3'").first()
    tools = Tools(store=store)
    assert tools.read_evidence(page_id=page.page_id)["text"] == "text 3" and tools.read_evidence(page_id=page.page_id, question="what?")["text"] == "text 3"
    assert [p["text"] for p in tools.read_evidence(doc_id=page.doc_id)["pages"]] == ["text 3"]
    assert "error" in tools.read_evidence(page_id="none:p1") and "error" in tools.read_evidence(doc_id="none")
