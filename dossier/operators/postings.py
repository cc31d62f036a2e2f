"""Inverted tables for BM25: terms, blocks of postings with their largest scores, and sums of the corpus that add up over commits.

A block holds what one term has in one tile, a set of about ``TILE`` chunks of one team (a document's chunks are in one tile). It says
the largest score that one of its postings can have. A search sums these over its terms by tile, scores the best tiles first,
and then reads only tiles whose sum reaches the score that is at rank ``limit`` so far: nothing else can come into the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: BM25 parameters and the separators of terms.
K1, B, SEPARATORS = 1.2, 0.75, r"[^\p{L}\p{N}]+"
#: Chunks of a tile, about, and tiles that a search scores first for each row that it wants.
TILE, FIRST = 64, 1
#: Tiles of a part where chunks are dealt by tile, and parts that there are at least if there are tiles enough.
TILES, LEAST_PARTS = 32, 16

BLOCKS = "term string, asset_team string, tile long, n int, top double, mean double, chunks array<struct<chunk_id: string, doc_id: string, tf: int, length: int>>"
#: Number and terms of the chunks of each team, and chunks that have a term: a commit's own, less what it deletes.
LENGTHS = "asset_team string, n long, total long"
FREQUENCIES = "term string, asset_team string, n long"
SUMS = {"lengths": ("asset_team",), "frequencies": ("term", "asset_team")}


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; nothing is stemmed. Texts and queries are lowered by this one function."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def wanted(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of a query."""
    return list(spark.sql("SELECT 1").select(F.sort_array(F.array_distinct(terms(F.lit(query))))).first()[0])


def term_table(rows: DataFrame, *id_cols: str, text_col: str = "text") -> DataFrame:
    """(term, ids..., length, tf): a row for each term of a text."""
    counted = rows.select(*id_cols, terms(F.col(text_col)).alias("terms")).withColumn("length", F.size("terms"))
    return counted.select(F.explode("terms").alias("term"), *id_cols, "length").groupBy("term", *id_cols, "length").agg(F.count("*").alias("tf"))


def weight(tf: Column, length: Column, mean: Column) -> Column:
    """BM25 of a posting, without the factor of its term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def in_tiles(rows: DataFrame, tiles: int, each: int) -> DataFrame:
    """Rows dealt by their column ``tile`` to parts of about ``each`` tiles (of one, as long as there are few): what is grouped by tile and more after that needs no other shuffle."""
    return rows.repartition(max(min(tiles, LEAST_PARTS), -(-tiles // each)), "tile")


def tiled_blocks(chunks: DataFrame, sums: DataFrame, tile: int = TILE) -> DataFrame:
    """The blocks of chunks (chunk_id, doc_id, asset_team, text), of which sums holds the ``lengths``; each part holds whole tiles, in the order of terms.

    Chunks are dealt by tile before they are taken apart, so that texts are shuffled once and postings never. ``blocks`` is for postings that are there.
    """
    total = sums.agg(F.sum("n"), F.sum("total")).first()
    n, mean = total[0] or 0, float((total[1] or 0) / total[0] if total[0] else 0) or 1.0
    tiles = max(1, round(n / tile))
    dealt = in_tiles(chunks.select("chunk_id", "doc_id", "asset_team", "text", F.pmod(F.xxhash64("doc_id"), F.lit(tiles)).alias("tile")), tiles, TILES)
    return _grouped(term_table(dealt, "chunk_id", "doc_id", "asset_team", "tile"), mean).sortWithinPartitions("term", "tile")


def _grouped(rows: DataFrame, mean: float) -> DataFrame:
    """One row for each term, team and tile of postings."""
    posting = F.struct("chunk_id", "doc_id", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"))
    return rows.groupBy("term", "asset_team", "tile").agg(F.count("*").cast("int").alias("n"), F.max(weight(F.col("tf"), F.col("length"), F.lit(mean))).alias("top"), F.lit(mean).alias("mean"), F.sort_array(F.collect_list(posting)).alias("chunks"))


def blocks(rows: DataFrame, files: int | None = None, tile: int = TILE, size: tuple[int, float] | None = None) -> DataFrame:
    """Blocks of postings (term, chunk_id, doc_id, asset_team, tf, length), in the order of terms. size: how many chunks there are, and their mean length."""
    n, mean = size or rows.select("chunk_id", "length").distinct().agg(F.count("*"), F.avg("length")).first()
    tiles, mean = max(1, round(n / tile)), float(mean or 1.0)
    made = _grouped(rows.withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.lit(tiles))), mean)
    made = made.repartitionByRange(files, "term", "tile") if files else made.repartitionByRange("term", "tile")
    return made.sortWithinPartitions("term", "tile")


def rows_of(blocks: DataFrame) -> DataFrame:
    """The postings of blocks: (term, chunk_id, doc_id, asset_team, tf, length, v)."""
    return blocks.select("term", "asset_team", "v", F.explode("chunks").alias("c")).select("term", "c.chunk_id", "c.doc_id", "asset_team", "c.tf", "c.length", "v")


def lengths(chunks: DataFrame, sign: int = 1) -> DataFrame:
    """The numbers and terms of chunks (asset_team, n_terms); taken away for sign = -1."""
    return chunks.groupBy("asset_team").agg((sign * F.count("*")).alias("n"), (sign * F.sum("n_terms")).cast("long").alias("total"))


def frequencies(rows: DataFrame, sign: int = 1) -> DataFrame:
    """How many chunks have a term, of postings (term, asset_team); taken away for sign = -1."""
    return rows.groupBy("term", "asset_team").agg((sign * F.count("*")).alias("n"))


def summed(rows: DataFrame, name: str) -> DataFrame:
    """Sums of several commits as one, in the order of terms."""
    keys = SUMS[name]
    values = [c for c in rows.columns if c not in (*keys, "v")]
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values)).where(" OR ".join(f"{c} <> 0" for c in values)).sort(*keys)


def in_team(df: DataFrame, asset_team: str | None) -> DataFrame:
    """Rows of one team, by exact name; no filter without one."""
    return df.where(F.col("asset_team") == asset_team) if asset_team else df


def alive(rows: DataFrame, deletes: DataFrame | None) -> DataFrame:
    """Postings (doc_id, v) whose document no later commit (doc_id, v) has deleted."""
    if deletes is None:
        return rows
    gone = deletes.groupBy(F.col("doc_id").alias("__id")).agg(F.max("v").alias("__v"))
    return rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("v") < F.col("__v")), "left_anti")


class Search:
    """BM25 of a query over blocks, corpus sums and deletions (doc_id, v). Only sums and the blocks' heads are read before a row is scored."""

    def __init__(self, tables: dict[str, DataFrame], query: str, asset_team: str | None = None) -> None:
        heads = tables["postings"]
        self.spark, self.deletes = heads.sparkSession, tables.get("deletes")
        self.terms = wanted(self.spark, query)
        sums = in_team(tables["lengths"], asset_team).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        self.n, self.mean = sums.n or 0, (sums.total or 0) / sums.n if sums.n else 0.0
        found = in_team(tables["frequencies"], asset_team).where(F.col("term").isin(self.terms)).groupBy("term").agg(F.sum("n").alias("df"))
        self.df = {r.term: r.df for r in found.collect() if r.df > 0}  # a row for each term of the query
        self.blocks = in_team(heads, asset_team).where(F.col("term").isin([*self.df]))
        factors = [x for t, df in sorted(self.df.items()) for x in (F.lit(t), rarity(F.lit(df), F.lit(self.n)))]
        self.factor = F.element_at(F.create_map(*factors), F.col("term")) if factors else F.lit(0.0)

    def tiles(self) -> DataFrame:
        """(v, asset_team, tile, bound): no chunk of a tile has a higher score. The mean length may have grown since a block was written, by which its largest score can grow as much at most."""
        most = F.col("top") * self.factor * F.greatest(F.lit(1.0), F.lit(self.mean) / F.col("mean"))
        return self.blocks.groupBy("v", "asset_team", "tile").agg((F.sum(most) * (1 + 1e-9)).alias("bound"))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """(chunk_id, score) of the postings of blocks; terms are added in their order."""
        each = alive(rows_of(blocks), self.deletes).select("chunk_id", F.struct("term", (self.factor * weight(F.col("tf"), F.col("length"), F.lit(self.mean))).alias("s")).alias("part"))
        return each.groupBy("chunk_id").agg(F.aggregate(F.sort_array(F.collect_list("part")), F.lit(0.0), lambda total, p: total + p["s"]).alias("score"))

    def of(self, tiles: DataFrame) -> DataFrame:
        """The blocks of some tiles; a null team is a team."""
        there = tiles.select(*(F.col(c).alias(f"__{c}") for c in ("v", "asset_team", "tile")))
        return self.blocks.join(there, (F.col("v") == F.col("__v")) & F.col("asset_team").eqNullSafe(F.col("__asset_team")) & (F.col("tile") == F.col("__tile")), "left_semi")

    def worth_reading(self, limit: int) -> DataFrame:
        """The blocks of all tiles that can have one of the best ``limit`` chunks."""
        tiles = self.tiles()
        best = tiles.orderBy(F.desc("bound"), "v", "asset_team", "tile").limit(FIRST * limit)
        first = self.scores(self.of(best)).orderBy(F.desc("score")).limit(limit).collect()  # as many rows as are wanted
        return self.of(tiles.where(F.col("bound") >= first[-1].score)) if len(first) == limit else self.blocks

    def top(self, limit: int) -> DataFrame:
        """(chunk_id, score) of the best chunks; ties go to the smaller id."""
        if not self.df or limit <= 0:
            return self.spark.createDataFrame([], "chunk_id string, score double")
        return self.scores(self.worth_reading(limit)).orderBy(F.desc("score"), "chunk_id").limit(limit)
