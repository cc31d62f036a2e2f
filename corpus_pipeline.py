"""A training corpus from raw documents: toxic, repeated and unbalanced text goes, tokens come out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, mixing, near_dup, sentences, toxicity
from dossier.llm.common import stash
from dossier.llm.queries import table, tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic. Empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    at = model.categories.index("toxic")
    judged = toxicity.classify(docs, model, keep=True, into="__verdict")
    return judged.where(F.col("__verdict")[at] < model.thresholds[at]).drop("__verdict")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose sets of five-word shingles are alike. Texts without words and rows without id stay."""
    groups = near_dup.near_duplicates(docs, words=5, percent=80)
    return docs.join(groups.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of runs that occur earlier; those that lose all their words go.

    Null texts and rows without id stay as they are; rows that repeat an id are judged as one text whose parts follow each other. Columns of any name pass.
    """
    left = F.col("__left")
    found = sentences.dedupe(docs, into="__left").where((left["removed"] == 0) | left["text"].rlike(r"\S"))
    n_chars = F.when(left["removed"] > 0, F.length(left["text"]).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": left["text"], "n_chars": n_chars}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of the sources at their target weights: documents that are taken twice are there twice.

    Rows without source are a source of their own, the last; null and empty texts have no words and come like others; rows that repeat an id fare alike. Columns of any name pass.
    """
    return mixing.copies(mixing.mix(docs, into="__mix"), into="__mix").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document of the mix."""
    return bpe.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: No SQL expresses a classifier chain or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
