import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from dossier.llm import near_dup, sentences, toxicity
from dossier.llm.common import stash

from .test_near_dup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, documents):
    """Each stage against a plain version of it on its own input."""
    f = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    judge = toxicity.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.CATEGORIES)
    clean = stash(f["toxicity"](spark, documents, sf), "t1")
    assert clean.columns == COLUMNS
    want = {i for i, r in rows(documents).items() if judge.classifier()(r.text)[1] < judge.thresholds[1]}
    assert set(rows(clean)) == want
    single = stash(f["near_duplicates"](spark, clean, sf), "t2")
    groups = brute([(i, r.text) for i, r in rows(clean).items()], 5, 80)
    assert set(rows(single)) == {i for i, (c, _) in groups.items() if i == c} and single.columns == COLUMNS
    unrepeated = stash(f["repeated_passages"](spark, single, sf), "t3")
    seen, left = set(), {}
    for i, r in sorted(rows(single).items()):
        starts = []
        for h, at in sentences.runs(r.text, sentences.SPAN, sentences.LEAST_WORDS):
            if h in seen:
                starts.append(at)
            seen.add(h)
        text, _, gone = sentences.cut(r.text, starts, sentences.SPAN)
        if not gone or text.strip():
            left[i] = text
    assert {i: r.text for i, r in rows(unrepeated).items()} == left and unrepeated.columns == COLUMNS
    assert all(r.n_chars == len(r.text) for r in rows(unrepeated).values())
    mixed = stash(f["mixing"](spark, unrepeated, sf), "t4")
    times: dict = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == COLUMNS and set(times) <= set(left) and max(times.values()) <= 2
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(words - 1.5 * sum(len(t.split()) for t in left.values())) <= 0.05 * words
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in f["bpe"](spark, mixed, sf).collect()[:50]:
        ids = tokenizer.encode(left[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids), r.decoded_sha256) == (len(ids), ids, hashlib.sha256(left[r.doc_id].encode()).hexdigest())


def test_edges(spark, sf, odd, empty):
    for df in (odd, empty):
        docs = df.select(*COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, sf), name)
        assert docs.count() <= 2 * df.count()
    assert near_dup.BANDS**2 == 100
