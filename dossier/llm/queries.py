"""The operators of this folder on the given tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hosts, oracles
from .common import stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every text."""
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and verdict of each category for every text."""
    from .toxicity import CATEGORIES, classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"), CATEGORIES))


@query
def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are alike."""
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a payload in a media column, read back, and as a page that refers to it between its first sentence and the rest."""
    from .common import stash_path
    from .media import features_of, padded, payloads, resolve, sequences, stored

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), text.cast("binary").alias("data"))
    media = spark.read.parquet(stash_path(stored(docs, "doc_id", "data"), "media", compression="zstd"))
    plain = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lead = F.substring_index("text", ".", 1)
    rest = F.substring("text", F.length(lead) + 1, F.length("text"))
    page = F.concat(F.lit("<p>"), plain(lead), F.lit('</p><figure><img src="sha256:'), F.sha2(padded(F.col("data")), 256), F.lit('"><figcaption>the text</figcaption></figure><p>'), plain(rest), F.lit("</p>"))
    pages = docs.select("doc_id", F.length("data").cast("long").alias("n_bytes"), page.alias("html"))
    found = resolve(sequences(pages, "doc_id", "html", keep=("n_bytes",)), payloads(features_of(media, "doc_id")), "doc_id", keep=("n_bytes",), kinds=("media",))
    return found.select("doc_id", "n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


@query
def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that repeat earlier runs of sentences: how many each document loses, and what is left."""
    from .sentences import dedupe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe(docs).select(
        "doc_id",
        F.col("left.sentences").cast("long").alias("n_sentences"),
        F.col("left.removed").cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"),
        F.length("left.text").cast("long").alias("n_kept_chars"),
        F.sha2(F.coalesce("left.text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("mix")
    return mixed.select("doc_id", m.size.alias("size"), m.source_size.alias("source_size"), m.target.alias("target"), (m.size * F.size(m.shards)).cast("long").alias("taken"), m.shards.alias("shards"))


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


ORACLES["op6_ann"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), q AS (
  SELECT *, row_number() OVER () AS nth FROM e WHERE vec_id % 100 = 0
), d AS (
  SELECT q.vec_id AS query_id, q.nth AS nth, c.vec_id AS vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, nth ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text that strings of 100 bytes repeat from earlier ones, and what is left."""
    from .suffixes import dedupe

    left = dedupe(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three quarters of the documents."""
    from .language import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


@query
def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts under a Katz backoff model of six sevenths of them."""
    from .katz import evaluate

    return evaluate(table(spark, sf_dir, "documents"), least=1)


@query
def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code in four codebooks of 256 entries, and its squared error."""
    from .balls import compress
    from .lookup import attach

    found = compress(table(spark, sf_dir, "embeddings"))
    by_label = stash(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return attach(found, by_label, "label", "vec_id").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


@query
def op13_subvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds over dictionaries of subvectors."""
    from .subvectors import cluster, with_inertia

    return with_inertia(cluster(table(spark, sf_dir, "embeddings")))


@query
def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it and its source, as its host, pass the quality rules."""
    from .hosts import judge

    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


ORACLES["op11_ball_codes"] = oracles.ball_codes()
ORACLES["op13_subvectors"] = oracles.subvectors()
ORACLES["op12_host_rules"] = oracles.host_rules(hosts.RULES, hosts.BASE, hosts.LIMIT, hosts.STRONGEST, hosts.WEAKEST)
