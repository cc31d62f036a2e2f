import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_identity(spark):
    key = "Team/My Well #3.final.PDF"
    want = "my-well-3-final-" + hashlib.sha1(key.encode()).hexdigest()[:8]
    assert one(spark, key, T.doc_id_for) == want
    assert one(spark, "???", T.doc_id_for).startswith("doc-")
    assert len(one(spark, "a" * 200 + ".txt", T.doc_id_for)) == 69


def test_gates(spark):
    want = {"a.pdf": "pdf", "a.LAS": "text", "a.tiff": "image", "b.xlsx": T.EXCEL_REASON, "c.kdex": "skip:kdex" + T.DEFERRED_REASON, "d": "skip:unsupported extension (none)", "e.docx": "skip:unsupported extension .docx"}
    assert {k: one(spark, k, T.classify) for k in want} == want


def test_chunks(spark):
    assert [len(c) for c in one(spark, "x" * 3000, T.chunks)] == [1200, 1200, 900]
    assert one(spark, "  \n\t", T.chunks) == []
    assert one(spark, None, T.chunks) == []
    assert len(one(spark, "y" * 540_000, lambda c: T.chunks(c, T.TEXT_MAX_CHUNKS))) == 50


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ab \n\x1c ", max_size=60))
def test_strip_as_python(spark, value):
    assert one(spark, value, T.strip) == value.strip()


def reference_chunks(value):
    body, out, start = value.strip(), [], 0
    while start < len(body):
        if body[start : start + 1200].strip():
            out.append(body[start : start + 1200])
        if start + 1200 >= len(body):
            break
        start += 1050
    return out


def test_chunks_as_a_loop(spark):
    for n in (0, 1, 1199, 1200, 1201, 2249, 2250, 2251, 5000):
        value = ("abc d" * n)[:n]
        assert one(spark, value, T.chunks) == reference_chunks(value)


def test_keys(spark):
    assert one(spark, " Big  Well ", T.normalize_key) == "_big__well_"
    assert one(spark, "winston #3H", T.fragment_key) == "winston_3h"
    assert one(spark, "reeves_county,_tx", T.strip_county) == "reeves"
    assert one(spark, "boles,_verdia_1h", T.strip_well_number) == "boles,_verdia"
    assert one(spark, 'a<b>&"', T.xml_escape) == "a&lt;b&gt;&amp;&quot;"


def test_references(spark):
    assert one(spark, "s3://b/runs/x.json", lambda c: T.allowed_parsed_ref(c, "b")) == "runs/x.json"
    assert one(spark, "s3://b2/runs/x.json", lambda c: T.allowed_parsed_ref(c, "b")) is None
    assert re.fullmatch("p/[0-9a-f]{24}.json", one(spark, "k", lambda c: T.cache_key(c, "p/")))
