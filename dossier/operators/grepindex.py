"""Grep by an index of trigrams: which three successive characters a pattern needs, which pages have them all, and the pattern itself on these.

``needs`` says what every text that a pattern finds must hold, as an AND/OR of trigrams. It is cautious: where Java's reading of
a pattern may differ from what is understood here, or where nothing is needed, it says so, and grep reads all pages. Pages are verified by the
pattern itself, so that the index decides only what is read. Case matters, as it does to grep.
"""

from __future__ import annotations

import re
from re import _constants as R  # the parsed form of patterns
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .postings import in_tiles
from .retrieval import grep

#: Pages of a row of the index, about, and the rarest trigrams that are looked up of those that must all be there.
TILE, LOOKED_UP = 1024, 4
#: Tiles of a part.
TILES = 2
#: What may mean something else, or change what letters mean, in Java: inline flags, classes within classes, quotes and some escapes.
UNSURE = re.compile(r"\(\?[A-Za-z-]+[:)]|\\[QEvhHRXGzZkNpPceaxu0]|&&|\[[^\]]*\[")

#: A need: True for none, a trigram, or ("all" | "any", needs).
Need = bool | str | tuple


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in one pass over its characters."""
    three = lambda chars: F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - 2, F.lit(0))), lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.array_distinct(bound(F.split(F.coalesce(text, F.lit("")), ""), three))


def build(pages: DataFrame, id_col: str = "page_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(gram, tile, n, ids): the pages that have a trigram, by tiles of pages; each part holds whole tiles, in the order of trigrams. Null and short texts have none.

    Pages are dealt by tile before they are taken apart, so that texts are shuffled once and trigrams never.
    """
    tiles = max(1, round(pages.count() / tile))
    dealt = in_tiles(pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(tiles)).alias("tile")), tiles, TILES)
    rows = dealt.select("id", "tile", F.explode(trigrams(F.col("text"))).alias("gram"))
    made = rows.groupBy("gram", "tile").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("id")).alias("ids"))
    return made.sortWithinPartitions("gram", "tile")


def _together(kind: str, parts: list[Need]) -> Need:
    if kind == "any" and any(p is True for p in parts):
        return True
    flat: list[Need] = []
    for p in parts:
        if p is not True:
            flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def literal_needs(text: str) -> Need:
    return _together("all", [text[i : i + 3] for i in range(len(text) - 2)])


def needs(pattern: str) -> Need:
    """What every text with a match of a regular expression must hold."""
    if UNSURE.search(pattern):
        return True
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return True
    if tree.state.flags & ~re.UNICODE.value:
        return True
    return _sequence(tree)


def _sequence(parts) -> Need:
    found: list[Need] = []
    run = ""
    for op, value in parts:
        if op is R.LITERAL:
            run += chr(value)
            continue
        found.append(literal_needs(run))
        run = ""
        if op is R.SUBPATTERN:
            found.append(_sequence(value[3]))
        elif op is R.ATOMIC_GROUP:
            found.append(_sequence(value))
        elif op is R.BRANCH:
            found.append(_together("any", [_sequence(branch) for branch in value[1]]))
        elif op in (R.MAX_REPEAT, R.MIN_REPEAT, R.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_sequence(value[2]))
    return _together("all", [*found, literal_needs(run)])


def _grams(need: Need) -> set[str]:
    return {need} if isinstance(need, str) else set().union(*map(_grams, need[1])) if isinstance(need, tuple) else set()


def candidates(index: DataFrame, need: Need) -> DataFrame:
    """(id) of the pages that have what is needed; of many trigrams that must all be there, the rarest are looked up."""
    read = index.where(F.col("gram").isin(sorted(_grams(need))))
    counts = {r.gram: r.n for r in read.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each trigram of the pattern

    def of(need: Need) -> DataFrame:
        if isinstance(need, str):
            return read.where(F.col("gram") == need).select(F.explode("ids").alias("id"))
        kind, parts = need
        if kind == "any":
            out = of(parts[0])
            for p in parts[1:]:
                out = out.union(of(p))
            return out.distinct()
        single = sorted((p for p in parts if isinstance(p, str)), key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
        out = None
        if single:
            each = read.where(F.col("gram").isin(single)).select("gram", F.explode("ids").alias("id"))
            out = each.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(single)).select("id")
        for p in parts:
            if isinstance(p, tuple):
                out = of(p) if out is None else out.join(of(p), "id", "left_semi")
        return out

    return of(need)


def grep_indexed(pages: DataFrame, index: DataFrame, pattern: str, regex: bool = False, limit: int = 20, asset_team: str | None = None) -> DataFrame:
    """The rows of ``grep``; texts are read of pages only that have what the pattern needs, and of all pages if it needs nothing."""
    need = needs(pattern) if regex else literal_needs(pattern)
    if need is not True:
        ids = candidates(index, need).withColumnRenamed("id", "__id")
        pages = pages.join(ids, F.col("page_id") == F.col("__id"), "left_semi")
    return grep(pages, pattern, regex, limit, asset_team)
