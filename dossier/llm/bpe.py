"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols.

Encoding splits a text at the special tokens, splits each rest by the
pre-tokenizer's pattern and merges each piece: all adjacent pairs that have a
rank wait in a heap; the lowest rank, then the leftmost, is merged first, and
entries whose symbols have changed since are skipped. A piece of n bytes takes
O(n log n), so that a word of a megabyte is no harder than a megabyte of words.
Decoding concatenates the vocabulary's strings.

Tokenizers are given as the JSON file of the ``tokenizers`` library; the
file's path is a parameter. Its content (a fixed file of about 1.5 MB) is sent
to the tasks, so that executors need not have the file.

Nulls count as empty texts (no tokens); empty texts have no tokens; repeated
rows are encoded each for itself; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose ids a Python worker remembers, in each of two generations.
REMEMBERED = 180_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself, or the next one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Codec:
    """A tokenizer's encoder and decoder."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        vocab: dict[str, int] = data["model"]["vocab"]
        self.first = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = rank
            self.merged.append((vocab[left], vocab[right], vocab[left + right]))
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.odd_space = regex.compile(r" \s|\s |^\s|\s$").search
        self.known = _Known(lambda piece: self.merge(piece.encode("utf-8")))
        self.known_words = _Known(self.word)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ids = list(map(self.first.__getitem__, piece))
        n = len(ids)
        if n < 2:
            return tuple(ids)
        rank_of, merged = self.merges.get, self.merged
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # an entry is rank * n + place: one integer, ordered by rank and then from the left
        queue = [rank * n + i for i, rank in enumerate(map(rank_of, zip(ids, ids[1:]))) if rank is not None]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            left, right, new = merged[rank]
            j = after[i]
            if j == n or ids[i] != left or ids[j] != right:
                continue  # stale: one of its symbols has been merged since
            ids[i] = new
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of((new, ids[k]))) is not None:
                    heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0 and (rank := rank_of((ids[h], new))) is not None:
                heappush(queue, rank * n + h)
        return tuple([i for i in ids if i >= 0])

    def word(self, word: str) -> tuple[int, ...]:
        pieces = self.pieces(word)
        if len(pieces) == 1:  # the caller remembers it
            return self.known.seen(word) or self.merge(word.encode("utf-8"))
        return tuple(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.at_special or not any(s in text for s in self.special):
            return list(chain.from_iterable(self.by_piece(text)))
        out: list[int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable(self.by_piece(part)))
        return out

    def by_piece(self, text: str):
        """Ids of the pieces in order.

        Where each space stands alone between other characters, no piece
        reaches over a space that it doesn't start with, so that words with
        the space before them can be looked up whole.
        """
        if self.odd_space(text):
            return map(self.known.__getitem__, self.pieces(text))
        first, *rest = text.split(" ")
        return chain((self.known_words[first],), map(self.known_words.__getitem__, map(" ".__add__, rest)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    """Ids by piece, worked out when first asked for.

    Of two generations, the older is dropped when the younger is full; very
    long pieces are not kept.
    """

    def __init__(self, work) -> None:
        self.work = work
        self.old: dict[str, tuple[int, ...]] = {}

    def seen(self, piece: str) -> tuple[int, ...] | None:
        return self.get(piece) or self.old.get(piece)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.work(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _sent(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


@lru_cache(maxsize=2)
def codec_of(content: str) -> Codec:
    """One codec for all tasks that a Python worker runs."""
    return Codec(content)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text."""
    sent = _sent(df, tokenizer)

    def make():
        codec = codec_of(sent.value)
        return lambda key, text: (key, codec.encode(text))

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"{id_col} {kind}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of token ids; null lists give empty texts."""
    sent = _sent(df, tokenizer)

    def make():
        codec = codec_of(sent.value)
        return lambda key, ids: (key, codec.decode(ids or []))

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col), make, f"{id_col} {kind}, text string")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode each text and decode its ids, in one pass.

    The digests are of the decimal ids joined by commas and of the decoded
    text, so that two runs, or this and another implementation, can be
    compared without moving the tokens.
    """
    sent = _sent(df, tokenizer)

    def make():
        codec = codec_of(sent.value)
        decimal = [str(i) for i in range(len(codec.strings))]

        def work(key, text):
            ids = codec.encode(text)
            digest = hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest()
            decoded = hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest()
            return (key, len(ids), digest, decoded, ids) if with_ids else (key, len(ids), digest, decoded)

        return work

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
