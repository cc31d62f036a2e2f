"""Quality rules of hosts: how often each host's documents fail the rules, shrunk to what hosts are like, and verdicts back to documents.

Every text is measured once (see ``MEASURES``), and rules are conditions on these measures. For each rule, failures are counted by
host; the hosts' rates are taken as drawn from a beta distribution, whose mean and strength are estimated by moments over all
hosts (the variance between hosts beyond what counts of their sizes have by chance). A host's rate is then
(strength * mean + failures) / (strength + documents): a host with few documents stays near the mean, one with many keeps its own rate.
A host fails if a rate is above ``limit``; documents are kept if they pass the base rules and their host passes.

A null text has no words; null hosts are one host of their own; rows that repeat an id are measured each for itself, and a null id has a row. Words are
runs of bytes other than space and 0x09 to 0x0D. An empty table gives an empty result. Other columns are dropped, so that none clashes. Texts are measured
in slices of bounded bytes (a longer text is a slice of its own); only measures are written, counted by host in each task and then over all, and join the hosts' verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stash
from .lookup import attach

#: Words of a window that may repeat.
WINDOW = 5
SYMBOLS, SPACES, LATER_BYTES = b"#*$%&|<>", b" \t\n\v\f\r", bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Conditions under which a document fails. Those in BASE decide about the document too, the others about its host only.
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "lengths": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE = ("few_words", "repeats")
#: A host fails if most of its documents do. A prior weighs as many documents as STRONGEST at most and WEAKEST at least, so that a few documents alone never fail a host.
LIMIT, STRONGEST, WEAKEST = 0.5, 1e6, 10.0


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case, without port and ``www.``; what is no URL stays as it is."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", "")).otherwise(url)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs of two columns of numbers."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """How many words of each text are in windows that it has twice or more. Windows are numbered exactly, not hashed."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if total < window:
        return np.zeros(len(texts), np.int64)
    word = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    number = word[: total - window + 1]
    for k in range(1, window):
        number = _ranks(number, word[k : total - window + 1 + k])
    start = np.flatnonzero(text[: len(number)] == text[window - 1 :])
    _, at, n = np.unique(number[start] * len(texts) + text[start], return_inverse=True, return_counts=True)
    again = start[n[at] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.bincount(text[np.cumsum(edge)[:-1] > 0], minlength=len(texts))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """(id, host, and MEASURES) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), (F.col("source") if host is None else host).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, rows = [], []
                for text in part.column(2).to_pylist():
                    found = text.split()
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    bare = text.translate(None, SPACES)
                    words.append(found)
                    rows.append((len(found), len(bare.translate(None, LATER_BYTES)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), len(lines)))
                n_words, chars, symbols, again, lines = (pa.array(c, pa.int64()) for c in zip(*rows))
                columns = [n_words, chars, symbols, again, pa.array(repeated_words(words)), lines]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(part.column(1), pa.string()), *columns], ["id", "host", *MEASURES])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass
class Prior:
    mean: float
    strength: float


def prior(documents: int, failures: int, squares: float, shares: float, hosts: int) -> Prior:
    """The beta prior by moments: from all documents and failures, the sums of documents^2 and of failures^2 / documents, and the hosts' number."""
    if not documents:
        return Prior(0.0, STRONGEST)
    p = failures / documents
    chance, room = hosts - 1, documents - squares / documents - (hosts - 1)
    if p in (0.0, 1.0) or room <= 0:
        return Prior(p, STRONGEST)
    share = ((shares - failures * failures / documents) / (p * (1 - p)) - chance) / room
    return Prior(p, STRONGEST if share <= 0 else min(STRONGEST, max(WEAKEST, 1 / share - 1)))


def priors(by_host: DataFrame, rules: dict[str, str] = RULES) -> dict[str, Prior]:
    """Each rule's prior from (host, documents, a count of failures by rule). Sums are decimal, so that they don't depend on their order."""
    each = [x for r in rules for x in (F.sum(r).alias(r), F.sum((F.col(r).cast("double") * F.col(r) / F.col("documents")).cast("decimal(38,6)")).alias(f"{r}_shares"))]
    s = by_host.agg(F.count("*").alias("hosts"), F.sum("documents").alias("documents"), F.sum(F.col("documents").cast("decimal(38,0)") * F.col("documents")).alias("squares"), *each).first()
    return {r: prior(s.documents or 0, s[r] or 0, float(s.squares or 0), float(s[f"{r}_shares"] or 0), s.hosts) for r in rules}


def verdicts(measures: DataFrame, rules: dict[str, str] = RULES, limit: float = LIMIT) -> DataFrame:
    """(host, documents, a count of failures by rule, and rates: the shrunk rate of each rule; failed) of each host."""
    counts = measures.groupBy("host").agg(F.count("*").alias("documents"), *(F.count_if(F.expr(c)).alias(r) for r, c in rules.items()))
    by_host = stash(counts, "hosts")
    found = priors(by_host, rules)
    rates = {r: (F.lit(p.strength * p.mean) + F.col(r)) / (F.lit(p.strength) + F.col("documents")) for r, p in found.items()}
    failed = F.lit(False)
    for rate in rates.values():
        failed = failed | (rate > limit)
    return stash(by_host.withColumn("rates", F.create_map(*(x for r, rate in rates.items() for x in (F.lit(r), rate)))).withColumn("failed", failed), "verdicts")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, limit: float = LIMIT) -> DataFrame:
    """(id, host, MEASURES, base_failed, host_failed, kept) of every row."""
    measures = stash(measured(docs, id_col, text_col, host), "measures")
    by_host = verdicts(measures, rules, limit).select("host", F.col("failed").alias("host_failed"))
    failed = F.lit(False)
    for r in base:
        failed = failed | F.expr(rules[r])
    found = attach(measures.withColumn("base_failed", failed), by_host, "host", "id")
    return found.select(F.col("id").alias(id_col), "host", *MEASURES, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
