"""A persisted BM25 index with block bounds, and a top-k search that skips blocks by them.

Units are ranged by length into tiles of a fixed number, so the units of a tile have like lengths and a
word's bound within a tile is tight. The postings of a word in a tile are one block, with the most that
any of its units gains from the word; blocks are stored by buckets of words. A search reads bounds first,
without postings: the sum of a question's bounds in a tile is the most that a unit there can score. A question's best
tiles give it a score that its k best reach at least; only the tiles whose bound reaches it are read (block-max pruning).
The result is that of ranking all units.

Tables of an index, below one folder: units (tile, ord, unit_id, n_terms), blocks (bucket, term, tile, n, bound,
postings), terms (bucket, term, df, n_tiles) and one row of facts (n_units, avg_terms, k1, b).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize_ident
from . import ranking
from .lineage import cut, kept, shared_path

TILE = 256  # units of a tile
BUCKETS = 64  # of words
UNITS_EACH = 1_000_000  # of a bucket's file
SALTED_TILES = 256  # a word's blocks are joined in parts of about so many tiles
BIN_TILES = 16  # tiles whose postings a task scores at once
_FOUND = 1e-6  # scores are rounded to six decimals, so bounds are compared with as much slack


_SCHEMAS = {
    "units": "tile long, ord int, unit_id string, n_terms int",
    "blocks": "term string, tile long, n long, bound double, postings array<struct<ord: int, tf: int, n_terms: int>>, bucket int",
    "terms": "bucket int, term string, df long, n_tiles long",
    "facts": "n_units long, avg_terms double, k1 double, b double",
}


@dataclass(frozen=True)
class Index:
    """An index below a folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def blocks(self, buckets: list[int]) -> DataFrame:
        """The blocks of some buckets: others' folders are not read."""
        return self.table("blocks").where(F.col("bucket").isin(buckets))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


_POSTING = pa.struct([("ord", pa.int32()), ("tf", pa.int32()), ("n_terms", pa.int32())])


def _gains(tf: np.ndarray, n_terms: np.ndarray, average: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_terms / average))


def _blocks_part(average: float, k1: float, b: float):
    """The blocks of a tile's words."""
    schema = pa.schema([("term", pa.string()), ("tile", pa.int64()), ("n", pa.int64()), ("bound", pa.float64()), ("postings", pa.list_(_POSTING))])

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("ord").combine_chunks()
        terms = held["terms"].combine_chunks()
        words = terms.flatten().dictionary_encode()
        if not len(words):
            return schema.empty_table()
        row = np.repeat(np.arange(held.num_rows), np.asarray(pc.fill_null(pc.list_value_length(terms), 0)))
        key, tf = np.unique(np.asarray(words.indices, np.int64) * held.num_rows + row, return_counts=True)
        word, row = key // held.num_rows, key % held.num_rows
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        n_terms = np.asarray(held["n_terms"])[row]
        postings = pa.StructArray.from_arrays([np.asarray(held["ord"])[row].astype(np.int32), tf.astype(np.int32), n_terms.astype(np.int32)], fields=list(_POSTING))
        lists = pa.ListArray.from_arrays(np.append(first, len(key)).astype(np.int32), postings)
        sizes, bound = np.diff(np.append(first, len(key))), np.maximum.reduceat(_gains(tf, n_terms, average, k1, b), first)
        return pa.table([words.dictionary.take(pa.array(word[first])), pa.array(np.repeat(np.asarray(held["tile"])[:1], len(first))), pa.array(sizes), pa.array(bound), lists], schema=schema)

    return run


def build(units: DataFrame, path: str | None = None, tokens=tokenize_ident, tile: int = TILE, k1: float = ranking.K1, b: float = ranking.B) -> Index:
    """Writes the index of units (unit_id, text) below the path, by default a new one in the shared folder.

    Null texts have no words and count as units, as do units of one id; ids are kept as strings.
    """
    spark = units.sparkSession
    path = path or shared_path(spark, "bm25-index")
    read = units.select(F.col("unit_id").cast("string").alias("unit_id"), tokens(F.col("text")).alias("terms")).withColumn("n_terms", F.size("terms"))
    # words are cut out once: ranging looks at lengths before it moves rows
    read.write.parquet(f"{path}/words")
    read = spark.read.schema(read.schema).parquet(f"{path}/words")
    ranged = read.repartitionByRange("n_terms", F.xxhash64("unit_id")).sortWithinPartitions("n_terms").withColumn("at", F.monotonically_increasing_id())
    # the upper bits of at are the partition, the lower 33 the row in it
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select((F.shiftright("at", 33) * (1 << 20) + (row / tile).cast("long")).alias("tile"), (row % tile).cast("int").alias("ord"), "unit_id", "n_terms", "terms")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/placed")
    placed.select("tile", "ord", "unit_id", "n_terms").write.parquet(f"{path}/units")
    facts = placed.agg(F.count("*").alias("n_units"), F.coalesce(F.avg("n_terms"), F.lit(0.0)).alias("avg_terms"), F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    facts.write.parquet(f"{path}/facts")
    index = Index(spark, path)
    told = index.table("facts").first()
    # a tile's words are counted in one task: what is shuffled is each unit once, not a row for each of its words
    counted = placed.select("tile", "ord", "n_terms", "terms").groupBy("tile").applyInArrow(_blocks_part(told.avg_terms, k1, b), "term string, tile long, n long, bound double, postings array<struct<ord: int, tf: int, n_terms: int>>")
    blocks = counted.withColumn("bucket", bucket_of(F.col("term")))
    # a bucket's blocks in more files the more units there are, so that a word of every tile is no single task's
    files = 1 + told.n_units // UNITS_EACH
    blocks.repartition("bucket", F.pmod(F.xxhash64(F.shiftright("tile", 8)), F.lit(files))).sortWithinPartitions("bucket", "term", "tile").write.partitionBy("bucket").parquet(f"{path}/blocks")
    index.table("blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.count("*").alias("n_tiles")).write.parquet(f"{path}/terms")
    return index


def _weights(index: Index, questions: DataFrame, tokens) -> tuple[DataFrame, list[int]]:
    """query_id, term, idf and salts of the questions' words that units have, and the buckets that hold them."""
    words = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("bucket", bucket_of(F.col("term")))
    buckets = sorted(r.bucket for r in words.select("bucket").distinct().collect())  # at most BUCKETS rows
    terms = index.table("terms").where(F.col("bucket").isin(buckets)).join(F.broadcast(index.table("facts")), how="cross")  # facts is one row
    idf = F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.select("term", "bucket", idf.alias("idf"), (1 + F.col("n_tiles") / SALTED_TILES).cast("int").alias("salts"))
    return cut(words.join(known, ["bucket", "term"])), buckets


def _met(weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Questions' words with the blocks of these words. Words of many tiles are joined in parts, others once."""
    asked = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    by_term = weights.select("bucket", "term", "salts").distinct()
    held = blocks.join(by_term, ["bucket", "term"]).withColumn("salt", F.pmod(F.xxhash64("tile"), F.col("salts")).cast("int")).drop("salts")
    return asked.join(held, ["bucket", "term", "salt"]).drop("salt", "salts")


def bounds(index: Index, questions: DataFrame, tokens=tokenize_ident) -> DataFrame:
    """query_id, tile, bound (the most that a unit of the tile can score) and n (postings of the question's words there), from block bounds alone."""
    weights, buckets = _weights(index, questions, tokens)
    met = _met(weights, index.blocks(buckets).select("bucket", "term", "tile", "n", "bound"))
    return met.groupBy("query_id", "tile").agg(F.sum(F.col("idf") * F.col("bound")).alias("bound"), F.sum("n").alias("n"))


def _scores_part(kind: pa.DataType, k: int | None, average: float, k1: float, b: float):
    """Scores of the units of a bin's tiles for the questions that need the tile, some questions at a time; with k, only what may be among a question's k best."""
    schema = pa.schema([("query_id", kind), ("tile", pa.int64()), ("ord", pa.int32()), ("score", pa.float64())])

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if not held.num_rows or not asked.num_rows:
            return out[0]
        held = held.sort_by("tile").combine_chunks()
        terms, lists = held["term"].combine_chunks(), held["postings"].combine_chunks()
        block = np.repeat(np.arange(held.num_rows), np.asarray(pc.list_value_length(lists)))
        place, tf, n_terms = (np.asarray(pc.struct_field(lists.flatten(), name)) for name in ("ord", "tf", "n_terms"))
        tile, gain = np.asarray(held["tile"])[block], _gains(tf, n_terms, average, k1, b)
        for at in range(0, asked.num_rows, 128):
            some = asked.slice(at, 128).combine_chunks()
            words, needed = some["terms"].combine_chunks(), some["tiles"].combine_chunks()
            vocabulary = pc.unique(words.flatten())
            weight = np.zeros((some.num_rows, len(vocabulary)))
            weight[np.repeat(np.arange(some.num_rows), np.asarray(pc.list_value_length(words))), np.asarray(pc.index_in(words.flatten(), vocabulary))] = np.asarray(some["idf"].combine_chunks().flatten())
            number = np.asarray(pc.fill_null(pc.index_in(terms, vocabulary), -1))[block]
            who, where = np.repeat(np.arange(some.num_rows), np.asarray(pc.list_value_length(needed))), np.asarray(needed.flatten())
            found = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
            for one in np.unique(where):
                low, high = np.searchsorted(tile, [one, one + 1])
                own = low + np.flatnonzero(number[low:high] >= 0)
                if len(own):
                    matrix = np.zeros((len(vocabulary), place[own].max() + 1))
                    matrix[number[own], place[own]] = gain[own]
                    questions = who[where == one]
                    scores = np.round(weight[questions] @ matrix, 6)
                    q, u = np.nonzero(scores > 0)
                    found.append((questions[q], np.full(len(q), one), u, scores[q, u]))
            q, tiles, units, scores = (np.concatenate(x) for x in zip(*found))
            if k is not None:
                order = np.lexsort((-scores, q))
                q, tiles, units, scores = q[order], tiles[order], units[order], scores[order]
                edge = np.minimum(np.searchsorted(q, q) + k, np.searchsorted(q, q, "right")) - 1
                near = scores >= scores[edge]  # ties at the edge stay for the global order
                q, tiles, units, scores = q[near], tiles[near], units[near], scores[near]
            out.append(pa.table([some["query_id"].take(pa.array(q)), pa.array(tiles), pa.array(units.astype(np.int32)), pa.array(scores)], schema=schema))
        return pa.concat_tables(out)

    return run


def _scored(index: Index, weights: DataFrame, buckets: list[int], tiles: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, tile, ord and score of the units of each question's tiles (query_id, tile); with k, at least each question's k best.

    Tiles are dealt in bins and questions in blocks, and a bin's postings meet a block's questions in one task, so the postings are
    shuffled once a block, and no pair of a question and a posting is a row.
    """
    facts = index.table("facts").first()
    blocks = max(1, math.ceil(weights.select("query_id").distinct().count() / ranking.BLOCK))
    bin_of = F.shiftright("tile", int(math.log2(BIN_TILES)))
    # blocks that no question needs are dropped before their postings are shuffled; by tables whose size the planner knows
    words, at = kept(weights.select("bucket", "term").distinct(), "asked-words"), kept(tiles.select("tile").distinct(), "asked-tiles")
    held = index.blocks(buckets).select("bucket", "term", "tile", "postings").join(words, ["bucket", "term"], "left_semi").join(at, "tile", "left_semi")
    held = held.select("term", "tile", "postings", bin_of.alias("_bin"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    told = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("w")).select("query_id", F.col("w.term").alias("terms"), F.col("w.idf").alias("idf"))
    asked = tiles.groupBy("query_id", bin_of.alias("_bin")).agg(F.collect_list("tile").alias("tiles")).join(told, "query_id").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    kind = weights.schema["query_id"].dataType
    part = _scores_part(to_arrow_type(kind), k, facts.avg_terms, facts.k1, facts.b)
    return held.groupBy("_bin", "_block").cogroup(asked.groupBy("_bin", "_block")).applyInArrow(part, f"query_id {kind.simpleString()}, tile long, ord int, score double")


def kept_tiles(index: Index, questions: DataFrame, k: int, tokens=tokenize_ident, first: int = 2) -> tuple[DataFrame, DataFrame, list[int]]:
    """The tiles (query_id, tile) that must be read for each question's k best units, with the questions' weights and their buckets.

    The `first` tiles of the highest bounds are read for a score that k units reach; where they have fewer units, all tiles stay.
    """
    weights, buckets = _weights(index, questions, tokens)
    met = _met(weights, index.blocks(buckets).select("bucket", "term", "tile", "bound"))
    most = cut(met.groupBy("query_id", "tile").agg(F.sum(F.col("idf") * F.col("bound")).alias("most")))
    begun = ranking.top(most, first, F.col("most").desc(), F.col("tile")).select("query_id", "tile")
    reached = ranking.top(_scored(index, weights, buckets, begun, k), k, F.col("score").desc(), F.col("tile"), F.col("ord"))
    least = reached.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    able = most.join(least, "query_id", "left").where(F.col("most") + _FOUND >= F.coalesce("least", F.lit(0.0)))
    return cut(able.select("query_id", "tile")), weights, buckets


def search(index: Index, questions: DataFrame, k: int = ranking.DOCS, tokens=tokenize_ident, first: int = 2) -> DataFrame:
    """query_id, unit_id, score and rank of the k best units for each question (query_id, text), as ranking.bm25 ranks all units; tokens must be those of the index."""
    able, weights, buckets = kept_tiles(index, questions, k, tokens, first)
    scored = _scored(index, weights, buckets, able, k)
    # names of units are looked up for those that can still be among the first k: rank() keeps ties at the edge
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    edge = scored.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    named = edge.join(index.table("units").select("tile", "ord", "unit_id"), ["tile", "ord"]).select("query_id", "unit_id", "score")
    return ranking.top(named, k, F.col("score").desc(), F.col("unit_id"))
