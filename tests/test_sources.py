from pyspark.sql import functions as F

from dossier.operators import graph, manifest, views
from dossier.sources import files


def test_manifest_csv(spark, tmp_path):
    head = "key,asset_team,well,category,entry_type,well_name_meta,bytes,parse_source,parsed_ref"
    (tmp_path / "m.csv").write_bytes(f'{head}\r\n"a, b.pdf",T,Alpha Gamma,c,AFE,m,1,pilot-x,\r\nk2,T,W,c,AFE,m,2,full,s3://b/runs/1\r\nk2,U,W,c,AFE,m,2,full,s3://b/runs/2\r\n'.encode())
    rows = files.manifest(spark, f"file://{tmp_path}/m.csv")
    got = rows.orderBy("ordinal").collect()
    assert got[0].key == "a, b.pdf" and got[0].parsed_ref == "" and not any("\r" in str(v) for r in got for v in r)
    assert {r.key: r.parsed_ref for r in files.parsed_refs(rows).collect()}["k2"] == "s3://b/runs/2"
    assert {r.key: r.asset_team for r in files.manifest_entries(rows).collect()}["k2"] == "T"
    assert files.ingestable(rows).count() == 2 and files.without_output(rows).count() == 1
    total, found = manifest.search_documents(rows, well="gamma")
    assert total.first()[0] == found.count() == 1


def test_graph_csv_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "Entity", 'a, "b"\nc', "{}")], "id string, type string, name string, properties string")
    edges = nodes.select(F.lit("1").alias("source"), F.lit("1").alias("target"), F.lit("x").alias("label"), F.lit("").alias("properties"))
    files.write_graph(nodes, edges.limit(0), f"file://{tmp_path}/g")
    back, none = files.graph(spark, f"file://{tmp_path}/g")
    assert back.first().name == 'a, "b"\nc' and none.count() == 0


def test_export_rows(spark):
    nodes = spark.createDataFrame([("1", {"type": "T", "label": "L", "name": "N", "text": "X", "k": "v"}), ("2", {"label": "L", "text": "X" * 600})], "id string, props map<string,string>")
    rows = {r.id: r for r in graph.node_rows(nodes).collect()}
    assert (rows["1"].type, rows["1"].name, rows["1"].properties) == ("T", "N", '{"k":"v"}')
    assert rows["2"].type == "L" and len(rows["2"].name) == 500
    edges = spark.createDataFrame([("1", "2", "x", None), ("1", "2", "x", {"relationship_name": "y"})], "source string, target string, label string, props map<string,string>")
    assert sorted(r.label for r in graph.edge_rows(edges).collect()) == ["x", "y"]
    one = spark.range(1).select(graph.fallback_label(F.lit("nope"), F.lit(""), F.lit("t")).alias("a"), graph.fallback_label(F.lit('{"relationship_name":"r"}'), F.lit("n"), F.lit("t")).alias("b")).first()
    assert (one.a, one.b) == ("t", "r")


def test_tags(spark):
    row = spark.range(1).select(graph.tags(F.lit('{"a":["s3key:x","s3key:y"],"b":"s3key:x","c":"s3key:"}'), "s3key:").alias("t")).first()
    assert row.t == ["x", "y"]


def test_views(spark):
    raw = [
        ("run", '{"output":{"chunks":[{"content":1},{"content":"two"},{"content":"nine","metadata":{"pageRange":{"start":9}}}]}}'),
        ("fields", '{"output":{"value":{"a":1},"metadata":{"a":{"citations":[{"page":{"number":4}},{"page":{}}]},"b":{}}}}'),
        ("view", '{"kind":"markdown","pages":[{"page":1,"markdown":"x"}],"pageCount":3}'),
        ("odd", '{"x":1}'),
        ("bad", "not json"),
    ]
    got = {r.key: r for r in views.normalize(spark.createDataFrame(raw, "key string, json string")).collect()}
    assert [(p.page, p.markdown) for p in got["run"].pages] == [(2, "two"), (9, "nine")]
    assert got["fields"].kind == "extraction" and got["fields"].field_pages == {"a": [4]} and got["fields"].page_count == 4
    assert got["view"].page_count == 3 and got["odd"].pages == [] and got["bad"].page_count == 0


def test_sample(spark):
    rows = spark.createDataFrame([(f"{t}{p}{i}", t, p) for t in "abc" for p in "xy" for i in range(10)], "key string, asset_team string, parse_source string")
    got = [r.key for r in manifest.trial_sample(rows, 12).orderBy("pick").collect()]
    assert got == [r.key for r in manifest.trial_sample(rows, 12).orderBy("pick").collect()]
    assert len({k[:2] for k in got}) == 6 and got[0] == "ax0" and got[1] == "ay9"


def test_slices(spark):
    pages = spark.createDataFrame([("k", 1, "x" * 30_000), ("k", 2, "y"), ("j", 1, "a" * 100), ("j", 2, "b")], "key string, page int, markdown string")
    got = {(r.key, r.page): len(r.markdown) for r in manifest.slice_pages(pages, "key").collect()}
    assert got == {("k", 1): 24_000, ("j", 1): 100, ("j", 2): 1}


def test_ontology(spark, tmp_path):
    (tmp_path / "o.owl").write_text(
        '<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="x#Well"><rdfs:subClassOf rdf:resource="x#Asset"/></owl:Class>'
        '<owl:ObjectProperty rdf:about="x#in"><rdfs:domain rdf:resource="x#Well"/><rdfs:range rdf:resource="x#County"/></owl:ObjectProperty>'
        '<rdf:Description rdf:about="#w1"><rdf:type rdf:resource="#Well"/><rdfs:label>W 1</rdfs:label></rdf:Description></rdf:RDF>'
    )
    o = files.ontology(spark, f"file://{tmp_path}/o.owl")
    assert [tuple(r) for r in o["classes"].collect()] == [("Well", "Asset")]
    assert [tuple(r) for r in o["properties"].collect()] == [("in", "Well", "County")]
    assert [tuple(r) for r in o["individuals"].collect()] == [("w1", "Well", "W 1")]


def test_retained_parses_and_nominations(spark, tmp_path):
    parsed = spark.sql("SELECT 'd1' AS doc_id, 'a.pdf' AS key, named_struct('pages', array(named_struct('items', array(named_struct('text', 'x', 'x', 1.5D, 'y', 2.0D, 'width', 3.0D, 'height', 4.0D))))) AS result")
    files.retain_raw(parsed, f"file://{tmp_path}/raw")
    back = files.raw(spark, f"file://{tmp_path}/raw", parsed.schema["result"].dataType.simpleString()).first()
    assert (back.doc_id, back.key, back.result.pages[0]["items"][0].width) == ("d1", "a.pdf", 3.0)
    (tmp_path / "n.csv").write_text("key,doc_id,well,category,format_gate,page_count\na.pdf,d1,W,c,pdf,3\n")
    assert files.nominations(spark, f"file://{tmp_path}/n.csv").first().doc_id == "d1"


def test_read_chain_keeps_what_it_parses(spark, tmp_path):
    """Reference, then cache, then a parse that later runs find in the cache."""
    cache = f"file://{tmp_path}/cache"
    make = lambda *keys: spark.createDataFrame([(k, "seen") for k in keys], "key string, body string")
    files.put_json(make("b", "a"), cache)
    read = lambda: spark.read.schema("key string, body string").json(cache)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string")
    calls = []
    parse = lambda keys: calls.append(1) or keys.withColumn("body", F.lit("parsed"))
    got = {r.key: (r.source, r.body) for r in views.read_views(asked, make("a"), read(), parse, lambda df: files.put_json(df, cache)).collect()}
    assert got == {"a": ("manifest", "seen"), "b": ("cache", "seen"), "c": ("parsed", "parsed")}
    again = {r.key: r.source for r in views.read_views(asked, make("a"), read(), parse, lambda df: None).collect()}
    assert again == {"a": "manifest", "b": "cache", "c": "cache"}


def test_json_and_run_ledger(spark, tmp_path):
    (tmp_path / "j/x").mkdir(parents=True)
    (tmp_path / "j/x/a.json").write_text('{"k":\n1}')
    rows = files.json_objects(spark, f"file://{tmp_path}/j").collect()
    assert [(r.key, r.json) for r in rows] == [("x/a.json", '{"k":\n1}')]
    path = f"file://{tmp_path}/runs"
    assert files.run_ledger(spark, path).count() == 0
    run = spark.createDataFrame([("a", "ok", 5), ("b", "failed", 0), ("c", "ok", 7)], "key string, status string, chars int")
    assert {r.status: (r.n, r.chars) for r in files.append_run_ledger(run, path, "t1").collect()} == {"ok": (2, 12), "failed": (1, 0)}
    assert {r.key for r in files.run_ledger(spark, path).collect()} == {"a", "c"}
