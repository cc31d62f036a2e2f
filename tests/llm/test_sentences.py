import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from dossier.llm import sentences

from .conftest import frame


@given(st.text(alphabet="ab .!?\n ", max_size=300))
def test_pieces_make_up_the_text(text):
    assert "".join(sentences.sentences(text)) == text


def test_long_sentences_are_cut_alike():
    body = " ".join(f"word{i}" for i in range(80))
    a, b = sentences.sentences("one two three " + body), sentences.sentences("other start here now " + body)
    assert set(a[2:]) & set(b[2:]) and len(a) > 5


def test_as_a_loop(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    seen, want = set(), {}
    for i, text in rows:
        starts = []
        for h, at in sentences.runs(text, sentences.SPAN, sentences.LEAST_WORDS):
            if h in seen:
                starts.append(at)
            seen.add(h)
        want[i] = sentences.cut(text, starts, sentences.SPAN)
    got = {r.doc_id: tuple(r.left) for r in sentences.dedupe(documents).collect()}
    assert got == want and any(n for _, _, n in want.values())


def test_shared_passage(spark):
    passage = " ".join(f"Alpha{i} beta gamma delta{i} epsilon. Zeta eta theta{i} iota." for i in range(6))
    df = frame(spark, [(1, f"First words here. {passage} Its own end.", "en", "s", 1), (2, f"Something else entirely {passage} and another end of it.", "en", "s", 1), (3, "Clean words only. They repeat nothing at all. Really nothing of it.", "en", "s", 1)])
    by = {r.doc_id: r.left for r in sentences.dedupe(df).collect()}
    assert by[1].removed == 0 and by[3].removed == 0 and by[2].removed >= 10
    assert by[2].text.startswith("Something else")


def test_edges(odd, empty):
    rows = sentences.dedupe(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "left"}
    by = {r.doc_id: r.left for r in rows}
    assert by[3].text is None and by[2].text == "" and by[6].text == "" and by[None].removed == 0
    assert sentences.dedupe(empty).count() == 0


def test_short_lines(spark):
    """Each run of three lines has nine words; none has twelve."""
    passage = "".join(f"Dish{i} with sauce{i}\n" for i in range(20))
    df = frame(spark, [(i, f"Menu of house {i}\n{passage}Closed on day {i}\n", "en", "s", 1) for i in range(3)])
    by = {r.doc_id: r.left for r in sentences.dedupe(df).collect()}
    assert by[0].removed == 0
    assert all(by[i].text == f"Menu of house {i}\nClosed on day {i}\n" and by[i].removed == 20 for i in (1, 2))


def test_three_sentences_with_a_long_one(spark):
    """The short sentences at both ends of a run go too, though the long one between them is cut."""
    run = "Why not? " + " ".join(f"word{i}" for i in range(40)) + ". It is so. "
    df = frame(spark, [(i, f"Begins as {i} does. {run}Ends as {i} does.", "en", "s", 1) for i in range(2)])
    by = {r.doc_id: r.left for r in sentences.dedupe(df).collect()}
    assert by[1].text == "Begins as 1 does. Ends as 1 does."


KINDS = {
    "words": lambda rng, n: "".join(f"w{rng.randrange(5000)} " for _ in range(n)),
    "tabs": lambda rng, n: "".join(f"w{rng.randrange(5000)}\t" for _ in range(n)),
    "few words": lambda rng, n: "".join(rng.choice(["yes ", "no ", "on "]) for _ in range(n)),
    "sentences": lambda rng, n: "".join(f"w{rng.randrange(5000)}" + (". " if rng.random() < 0.08 else " ") for _ in range(n)),
    "characters": lambda rng, n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n * 2)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_every_passage_of_fifty_words_is_found(kind):
    """Shared passages in different surroundings have a run in common."""
    rng, make = random.Random(7), KINDS[kind]
    for _ in range(1000):
        passage = make(rng, 4 * sentences.LONG + 2)
        a, b = ({h for h, _ in sentences.runs(make(rng, rng.randint(0, 40)) + passage + make(rng, rng.randint(0, 40)), 3, 12)} for _ in range(2))
        assert a & b


def test_pieces_are_bounded():
    for kind in KINDS:
        assert max(len(p.split()) for p in sentences.sentences(KINDS[kind](random.Random(3), 3000))) <= sentences.LONG
    assert max(map(len, sentences.sentences("\u4e00\u4e8c\u4e09" * 1000))) <= sentences.LONG


def test_chance_matches_of_64_bits_remove_nothing(spark, monkeypatch):
    """Runs that agree in 64 bits of their hash, or in the other 32, are not the same."""
    rows = spark.createDataFrame([(5, 1, 1, 0), (5, 2, 2, 0), (6, 1, 3, 0), (5, 1, 4, 0)], "h long, more int, id long, at int")
    monkeypatch.setattr(sentences, "spans", lambda *_: rows)
    docs = spark.createDataFrame([(i, "x") for i in range(1, 5)], "doc_id long, text string")
    assert [(r.doc_id, r.starts) for r in sentences.removals(docs).collect()] == [(4, [0])]
