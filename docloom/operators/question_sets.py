"""Development and held-out questions from candidates: seeded, stratified, and without a leak between the sets.

Candidates that share a fact (a key) are linked; whatever is linked, over any number of steps, goes to one set, so no fact
that a development question tells is asked in the held-out set. Components are labelled by their smallest candidate, in rounds of
minima over keys with pointer jumping; the set follows a hash of the label, and of each kind a set takes its first n
usable candidates in the seeded order, those with priority before others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SETS = ("dev", "heldout")


def components(keyed: DataFrame) -> DataFrame:
    """cand and label, the smallest candidate that shares keys with it over any number of steps, for pairs (cand, key)."""
    pairs = cut(keyed.select("cand", "key").distinct())
    labels = cut(pairs.groupBy("cand").agg(F.col("cand").alias("label")))
    while True:
        by_key = pairs.join(labels, "cand").groupBy("key").agg(F.min("label").alias("label"))
        near = pairs.join(by_key, "key").groupBy("cand").agg(F.min("label").alias("near"))
        # a label's own label is in the same component: following it halves the way
        jump = labels.select(F.col("cand").alias("near"), F.col("label").alias("jump"))
        moved = cut(labels.join(near.join(jump, "near"), "cand").select("cand", F.least("near", "jump").alias("new"), "label"))
        if moved.where("new <> label").isEmpty():
            return labels
        labels = moved.select("cand", F.col("new").alias("label"))


def seeded(seed: int, *values: Column) -> Column:
    """Where the seed puts values: the first 15 hexadecimal digits of a digest, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *values).cast("binary")), 1, 15), 16, 10).cast("long")


def allocate(candidates: DataFrame, each: int, seed: int = 7) -> DataFrame:
    """The chosen candidates' columns with set_ and place (from 1, of their kind in the set).

    candidates have cand (unique), stratum, kind, keys (array of strings), usable and priority (booleans). Candidates without
    keys share nothing. Sets have `each` candidates of a kind, or as many as there are.
    """
    keyed = candidates.select(F.col("cand").cast("string").alias("cand"), F.explode(F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.array(F.concat(F.lit("\0"), F.col("cand").cast("string"))))).alias("key"))
    placed = candidates.withColumn("_c", F.col("cand").cast("string")).join(components(keyed).withColumnsRenamed({"cand": "_c", "label": "_label"}), "_c")
    which = F.when(seeded(seed, F.lit("set"), F.col("_label")) % 2 == 0, SETS[0]).otherwise(SETS[1])
    order = Window.partitionBy("kind", "set_").orderBy(F.col("priority").desc(), seeded(seed, F.col("kind"), F.col("_c")), "_c")
    chosen = placed.where("usable").withColumn("set_", which).withColumn("place", F.row_number().over(order).cast("long"))
    return chosen.where(F.col("place") <= each).drop("_c", "_label")


def worded(chosen: DataFrame) -> DataFrame:
    """query_id, set_, stratum, kind, suffix, text and gold of chosen candidates (text_t, text_p, gold): a template and a paraphrase of each."""
    both = F.explode(F.array(F.struct(F.lit("t").alias("suffix"), F.col("text_t").alias("text")), F.struct(F.lit("p").alias("suffix"), F.col("text_p").alias("text"))))
    rows = chosen.select("*", both.alias("_w"))
    name = F.concat_ws("-", "set_", "kind", "place", F.col("_w.suffix"))
    return rows.select(name.alias("query_id"), "set_", "stratum", "kind", F.col("_w.suffix").alias("suffix"), F.col("_w.text").alias("text"), "gold")


def leaks(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """key: the facts (query_id, key) that questions (query_id, set_) of both sets tell; none after allocate."""
    return keys.join(questions.select("query_id", "set_"), "query_id").groupBy("key").agg(F.count_distinct("set_").alias("n")).where("n > 1").select("key")
