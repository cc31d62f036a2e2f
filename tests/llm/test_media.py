import hashlib
import zlib

from pyspark.sql import functions as F

from dossier.llm import media, queries

HTML = '<p>One <b>two</b></p><script>no</script><figure><img src="sha256:%s" alt="x"><img src="other.png"><figcaption>A <i>caption</i></figcaption></figure><p>three</p><img src="sha256:%s" alt="alt text">'


def test_reading():
    items = media.read_html(HTML % ("a" * 64, "b" * 64))
    assert [(k, t or c) for _, k, t, _, c in items] == [("text", "One two"), ("media", "A caption"), ("media", "A caption"), ("text", "three"), ("media", "alt text")]
    assert [p for p, *_ in items] == list(range(5)) and media.read_html(None) == []


def test_malformed():
    read = lambda html: [(t or r, c) for _, _, t, r, c in media.read_html(html)]
    assert read("<figure><img src=a><figcaption>cap<p>later") == [("a", "cap"), ("later", None)]
    assert read("<figure><img src=a><figcaption>one<figure><img src=b><figcaption>two</figure>end") == [("a", "one"), ("b", "two"), ("end", None)]
    assert read("<figure><img src=a><figcaption><p>cap</p></figcaption></figure>x") == [("a", "cap"), ("x", None)]
    assert read("<template><img src=a>no</template>yes<style>p{}</style>") == [("yes", None)]
    assert read("<p>open <figure><figcaption>x") == [("open", None)]


def test_positions_stay_aligned(spark):
    data = b"payload"
    digest = hashlib.sha256(media.pad(data)).hexdigest()
    pages = spark.createDataFrame([(1, HTML % (digest, "b" * 64), "c"), (2, None, "c")], "page_id long, html string, caption string")
    rows = spark.createDataFrame([(1, bytearray(data)), (1, bytearray(data)), (None, None)], "id long, data binary")
    payloads = media.payloads(media.features_of(media.stored(rows, "id", "data"), "id"))
    assert payloads.count() == 2
    rows = media.resolve(media.sequences(pages, "page_id", "html"), payloads, "page_id").orderBy("page_id", "pos").collect()
    assert [r.pos for r in rows] == list(range(5)) and rows[1].payload_bytes == 64 and rows[1].caption == "A caption"
    assert rows[4].payload_bytes is None and rows[4].caption == "alt text"


def test_stored_and_read_back(odd):
    raw = odd.select("doc_id", F.col("text").cast("binary").alias("data"))
    kept = media.stored(raw, "doc_id", "data")
    for got, made, row in zip(media.features_of(kept, "doc_id").collect(), kept.collect(), odd.collect()):
        payload = media.pad((row.text or "").encode())
        assert media.from_wav(bytes(made.media)) == payload
        assert (got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got.media_bytes, got.media_sha256) == (len(made.media), hashlib.sha256(bytes(made.media)).hexdigest())


def test_query(spark, sf, documents):
    rows = {r.doc_id: r for r in queries.op9_media(spark, sf).collect()}
    for d in documents.collect():
        payload = media.pad((d.text or "").encode())
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.caption == "the text" and r.pos == (1 if (d.text or "").split(".")[0].strip() else 0)
    assert len(rows) == documents.count()


def test_edges(spark):
    """Null, empty and repeated rows, empty tables and names that clash."""
    digest = hashlib.sha256(media.pad(b"")).hexdigest()
    rows = [(1, None, "p", "d", 5), (None, f"<p>a<img src='sha256:{digest}'>", "p", "d", 6), (2, "", "p", "d", 7), (3, "a<img src='sha256:x'>b", "p", "d", 8), (3, "a<img src='sha256:x'>b", "p", "d", 8)]
    pages = spark.createDataFrame(rows, "page_id long, html string, pos string, digest string, n long")
    payloads = media.payloads(media.features_of(media.stored(spark.createDataFrame([(1, None)], "id long, data binary"), "id", "data"), "id"))
    got = sorted(((r.page_id or 0, r.n, r.pos, r.kind, r.payload_bytes) for r in media.resolve(media.sequences(pages, "page_id", "html", ("n",)), payloads, "page_id", ("n",)).collect()), key=str)
    three = [(3, 8, 0, "text", None), (3, 8, 1, "media", None), (3, 8, 2, "text", None)]
    assert got == sorted([(0, 6, 0, "text", None), (0, 6, 1, "media", 64), *three, *three], key=str)
    assert media.resolve(media.sequences(pages.limit(0), "page_id", "html"), payloads.limit(0), "page_id").count() == 0
