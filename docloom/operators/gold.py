"""Gold sets: parameterised SQL over fact tables, and comparing a set of rows with what its SQL gives again."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import kept


def run_gold(spark: SparkSession, sql: str, params: list, **tables: DataFrame) -> DataFrame:
    """The rows of a statement whose tables are named in braces and whose parameters are question marks."""
    pieces = sql.split("?")
    named = "".join(piece + f":p{i}" for i, piece in enumerate(pieces[:-1])) + pieces[-1]
    return spark.sql(named, args={f"p{i}": value for i, value in enumerate(params)}, **tables)


def recheck(stored: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """Rows of one side only, with the side: none if the stored set is what its statement gives."""
    marked = stored.select(*keys).distinct().withColumn("_s", F.lit(1)).join(fresh.select(*keys).distinct().withColumn("_f", F.lit(1)), list(keys), "full")
    return marked.where("_s is null or _f is null").select(*keys, F.when(F.col("_s").isNull(), "missing").otherwise("stale").alias("problem"))


#: Consecutive words of an item that a unit is looked up by: as many of these as the item has; each is twice the one before. Characters of items that one broadcast holds.
_RUNS, _BLOCK_CHARS = (1, 2, 4, 8), 32_000_000


def _with_runs(df: DataFrame, words: str, runs: list[int]) -> DataFrame:
    """df with _run<n>: hashes of the n words from each place on, of what is left where fewer follow. A run's hash is that of its halves' hashes."""
    df = df.withColumn("_run1", F.transform(words, lambda w: F.xxhash64(w)))
    for n in [n for n in _RUNS if n < max(runs, default=1)]:
        df = df.withColumn(f"_run{2 * n}", F.zip_with(f"_run{n}", F.slice(f"_run{n}", F.lit(1 + n), F.size(f"_run{n}")), lambda a, b: F.xxhash64(a, b)))
    return df


def containment(units: DataFrame, items: DataFrame) -> DataFrame:
    """unit_id and query_id of the units (unit_id, text) that hold an item's whole text (query_id, text).

    An item's words but for the first and the last stand between spaces in a unit that holds it, so units and items meet by
    a run of up to eight of them, that which the fewest items have. Items of one or two words meet by their first three
    characters (shorter ones by all of theirs). Empty items are in none. The text is compared where its runs are met, so neither
    texts nor words are shuffled: items are broadcast in blocks of bounded size, and each block reads the units.
    """
    words = F.split("item", " ")
    items = items.where(F.length("text") > 0).select("query_id", F.col("text").alias("item")).distinct()
    items = items.withColumn("inner", F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    items = items.withColumn("run", F.coalesce(*[F.when(F.size("inner") >= n, n) for n in reversed(_RUNS)], F.lit(0)))
    items = items.withColumn("size", F.when(F.col("run") == 0, F.least(F.length("item"), F.lit(3))).otherwise(0))
    told = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars"), F.collect_set("run").alias("runs"), F.collect_set("size").alias("sizes")).first()  # at most five and four numbers
    blocks, runs, sizes = max(1, math.ceil(told.chars / _BLOCK_CHARS)), sorted({*told.runs} - {0}), sorted({*told.sizes} - {0})
    units = units.where("text is not null").select("unit_id", "text")
    met = []  # units' keys, and items with theirs
    if runs:
        own = _with_runs(items.where("run > 0"), "inner", runs)
        whole = F.coalesce(*[F.when(F.col("run") == n, F.slice(f"_run{n}", F.lit(1), F.greatest(F.size("inner") - n + 1, F.lit(1)))) for n in runs])
        keys = own.select("query_id", "item", F.explode(F.array_distinct(whole)).alias("key"))
        rare = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("query_id", "item").agg(F.min(F.struct("n", "key")).alias("r"))
        held = _with_runs(units.withColumn("words", F.split("text", " ")), "words", runs).select("unit_id", "text", F.explode(F.array_distinct(F.flatten(F.array(*[f"_run{n}" for n in runs])))).alias("key"))
        met.append((held, kept(rare.select("query_id", "item", "r.key"), "runs")))
    if sizes:
        of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.col("text").substr(i, F.lit(n)))
        grams = F.flatten(F.array(*[of_size(n) for n in sizes]))
        met.append((units.select("unit_id", "text", F.explode(F.array_distinct(grams)).alias("key")), items.where("run = 0").select("query_id", "item", F.col("item").substr(F.lit(1), F.col("size")).alias("key"))))
    block = F.pmod(F.xxhash64("query_id", "item"), F.lit(blocks))
    found = [held.join(F.broadcast(own.where(block == i)), "key").where(F.contains("text", "item")).select("unit_id", "query_id") for held, own in met for i in range(blocks)]
    return reduce(DataFrame.unionByName, found).distinct() if found else units.join(items, F.lit(False)).select("unit_id", "query_id")
