"""Substring deduplication by sliding spans of sentences.

Each text is cut into sentences: after ``.``, ``!`` or ``?`` before white
space, and at line ends. Every run of ``span`` consecutive sentences is hashed,
however short, and all runs are joined over the whole corpus; the first occurrence
of a run (smallest id, then earliest place) stays, and the sentences that any other
occurrence covers are removed. Texts are judged as given, not as they are after removals.

A sentence of more than LONG words is cut further, so that a passage is also found
where it stands in other surroundings: of each LONG consecutive words the
one with the least hash (the last of equals) ends a piece. Pieces thus depend on nothing farther than
LONG words, and have at most LONG words. Every run of ``span`` pieces that aren't
all whole sentences is hashed too; one of fewer than ``least_words`` words
takes in the pieces after it until it has these. So each passage of 4 * LONG + 2
words that two texts share holds a run of both. The characters of a word of over
UNSPACED bytes (scripts without spaces) are cut as words are, and count as a word for each LETTERS bytes.

White space around a sentence and the case of ASCII letters do not count. Runs are told apart by 96 bits
of hash: with 10^12 of them, some 10^-5 chance matches are expected.

Null and empty texts have no sentences and are returned unchanged; a text
with fewer than ``span`` sentences has one run, all of it. Rows that repeat
an id count as one text whose parts follow each other, and equal rows with one id are judged once. Rows with a null id are kept
whole and repeat nothing.
"""

from __future__ import annotations

import re
import struct
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_column, drop_path, map_rows, stash, stash_path

SPAN, LEAST_WORDS, LONG = 3, 12, 12
#: Bytes that count as a word, and those of the longest word that is one.
LETTERS, UNSPACED = 6, 72
#: Words whose hash a task remembers.
REMEMBERED = 120_000
#: One sentence with the white space after it.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?!\s|$)[^.!?\n]*)*(?:[.!?]+\s*|\n\s*|$)")
WORD_AND_SPACE = re.compile(r"\S+\s*")
CHARACTER = re.compile(r"\S\s*")
#: The two parts of a run's hash.
_TWO = struct.Struct(">qi")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(_plain(word))
        return h


def _plain(piece: str) -> bytes:
    return piece.strip().encode("utf-8").translate(_LOWER)


_HASHES = _Hashes()


def _units(words: list[str]) -> tuple[list[str], list[int]]:
    """Words, and the characters of those that are too long, with what each counts in LETTERS-ths of a word."""
    units: list[str] = []
    counts: list[int] = []
    for word in words:
        if len(word) * 4 > UNSPACED and len(_plain(word)) > UNSPACED:
            characters = CHARACTER.findall(word)
            units += characters
            counts += [len(_plain(c)) for c in characters]
        else:
            units.append(word)
            counts.append(LETTERS)
    return units, counts


def _ends(hashes: list[int]) -> list[int]:
    """Where the least hash of each LONG consecutive ones is, the last of equals."""
    out: list[int] = []
    best = last = -1
    least = 1 << 32
    for at, h in enumerate(hashes):
        if h <= least:
            best, least = at, h
        elif at - best >= LONG:
            best = at - LONG + 1
            least = hashes[best]
            for k in range(best + 1, at + 1):
                if hashes[k] <= least:
                    best, least = k, hashes[k]
        if best != last and at >= LONG - 1:
            out.append(best)
            last = best
    return out


def pieces(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """Pieces that make up the text, what each counts in LETTERS-ths of a word, and the first piece of each sentence."""
    out: list[str] = []
    counts: list[int] = []
    firsts: list[int] = []
    for sentence in SENTENCE.findall(text or ""):
        if not sentence:
            continue
        firsts.append(len(out))
        words = WORD_AND_SPACE.findall(sentence) if len(sentence) > UNSPACED // 4 else []
        short = not words or max(map(len, words)) * 4 <= UNSPACED
        if short and len(words) <= LONG:
            out.append(sentence)
            counts.append(LETTERS * len(words or sentence.split()))
            continue
        units, each = (words, [LETTERS] * len(words)) if short else _units(words)
        if len(units) <= LONG:
            out.append(sentence)
            counts.append(sum(each))
            continue
        lead, done = sentence[: len(sentence) - len(sentence.lstrip())], 0
        for end in (*_ends([*map(_HASHES.__getitem__, units)]), len(units) - 1):
            if end >= done:
                out.append(lead + "".join(units[done : end + 1]))
                counts.append(sum(each[done : end + 1]))
                lead, done = "", end + 1
    return out, counts, firsts


def sentences(text: str | None) -> list[str]:
    """Pieces that make up the text."""
    return pieces(text)[0]


def places(counts: list[int], firsts: list[int], span: int, least_words: int) -> list[tuple[int, int, int]]:
    """(at, first piece, end) of each run, in order of at: even for runs of sentences, odd for those of pieces."""
    n, m = len(counts), len(firsts)
    starts = [*firsts, n]
    out = [(2 * starts[k], starts[k], starts[min(k + span, m)]) for k in range(max(1, m - span + 1))] if m else []
    if n == m:
        return out
    words = [0, *accumulate(counts)]
    parts = [0, *accumulate(k for a, b in zip(starts, starts[1:]) for k in ((0,) if b - a == 1 else (1,) * (b - a)))]
    need, j = least_words * LETTERS, 0
    for i in range(n):
        j = max(j, i + span)
        while j <= n and words[j] - words[i] < need:
            j += 1
        if j > n:
            break
        if parts[j] > parts[i]:
            out.append((2 * i + 1, i, j))
    out.sort()
    return out


def runs(text: str | None, span: int, least_words: int) -> list[tuple[tuple[int, int], int]]:
    """(hash, place) of each run that has words; a short text has one run. A hash is 64 bits and 32 more, both signed."""
    parts, counts, firsts = pieces(text)
    plain = [*map(_plain, parts)]
    of = dict(zip(firsts, plain if len(firsts) == len(parts) else [_plain("".join(parts[a:b])) for a, b in zip(firsts, [*firsts[1:], len(parts)])]))
    out = []
    for at, i, j in places(counts, firsts, span, least_words):
        run = plain[i:j] if at % 2 else [of[k] for k in range(i, j) if k in of]
        if any(run):
            h, more = _TWO.unpack(xxhash.xxh3_128_digest(b"\n".join(run), at % 2)[:12])
            out.append(((h, more), at))
    return out


def spans(docs: DataFrame, span: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(h, more, id, at): a row for each run."""

    def make():
        return lambda key, text: [(h, more, key, i) for (h, more), i in runs(text, span, least_words)]

    rows = docs.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return map_rows(rows, make, f"h long, more int, id {dict(docs.dtypes)[id_col]}, at int")


def removals(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts): the places of the runs of each document that occur earlier."""
    # written once: cutting the texts takes longer than reading the runs twice
    rows_at = stash_path(spans(docs, span, least_words, id_col, text_col), "runs")
    rows = docs.sparkSession.read.parquet(rows_at)
    # map-side combining: a very common run reaches the shuffle once per task
    first = rows.groupBy("h", "more").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "more", "first")
    # a table of its own, so that the join deals out its rows anew and can split a very common run
    first_at = stash_path(first, "first")
    later = rows.join(docs.sparkSession.read.parquet(first_at), ["h", "more"]).where(F.struct("id", "at") != F.col("first"))
    found = stash(later.groupBy(F.col("id").alias(id_col)).agg(F.sort_array(F.collect_set("at")).alias("starts")), "removals")
    for at in (rows_at, first_at):
        drop_path(docs.sparkSession, at)
    return found


def cut(text: str | None, starts: list[int] | None, span: int, least_words: int = LEAST_WORDS) -> tuple[str | None, int, int]:
    """The text without the pieces of the runs at those places; the number of pieces, and of those removed."""
    parts, counts, firsts = pieces(text)
    gone: set[int] = set()
    if starts is not None and len(starts):
        chosen = set(starts)
        for at, i, j in places(counts, firsts, span, least_words):
            if at in chosen:
                gone.update(range(i, j))
    return (text if not gone else "".join(p for i, p in enumerate(parts) if i not in gone), len(parts), len(gone))


def dedupe(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", into: str = "left") -> DataFrame:
    """All rows and columns of docs, and ``into`` (in place of a column of that name): a struct of the text that is left, its pieces (sentences, or parts of long ones) before, and those removed."""
    found = removals(docs, span, least_words, id_col, text_col).withColumnsRenamed({id_col: "__id", "starts": "__starts"})

    def make():
        def left(text, starts):
            return dict(zip(("text", "sentences", "removed"), cut(text, starts, span, least_words)))

        return left

    joined = docs.join(found, docs[id_col] == F.col("__id"), "left").drop("__id")
    made = add_column(joined, [text_col, "__starts"], make, "__left", "struct<text: string, sentences: int, removed: int>")
    return made.select(*(c for c in docs.columns if c != into), F.col("__left").alias(into))
