"""Allotting questions to sets against plain components, and the promises of the sets."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import question_sets

SCHEMA = "cand string, stratum string, kind string, keys array<string>, usable boolean, priority boolean, text_t string, text_p string, gold array<string>"


def _candidates(n: int, n_keys: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        keys = [f"k{rng.randrange(n_keys)}" for _ in range(rng.randrange(0, 3))]
        rows.append((f"c{i:03d}", "S1", f"kind{i % 3}", keys if i % 17 else None, i % 5 != 0, i % 4 == 0, f"t{i}", f"p{i}", ["g"]))
    return rows


def _plain(rows):
    label = {r[0]: r[0] for r in rows}
    moved = True
    while moved:
        moved, least = False, {}
        for r in rows:
            for k in r[3] or []:
                least[k] = min(least.get(k, label[r[0]]), label[r[0]])
        for r in rows:
            new = min([label[r[0]], *(least[k] for k in r[3] or [])])
            moved |= new != label[r[0]]
            label[r[0]] = new
    return label


@pytest.mark.parametrize("n_keys", [40, 400])
def test_linked_candidates_share_a_set(spark, n_keys):
    rows = _candidates(200, n_keys, n_keys)
    keyed = [(r[0], k) for r in rows for k in [*(r[3] or []), "\0" + r[0]]]
    found = {r.cand: r.label for r in question_sets.components(spark.createDataFrame(keyed, "cand string, key string")).collect()}
    assert found == _plain(rows)
    chosen = question_sets.allocate(spark.createDataFrame(rows, SCHEMA).repartition(3), 12).collect()
    sets = {}
    for r in chosen:
        assert r.usable
        sets.setdefault(found[r.cand], set()).add(r.set_)
    assert all(len(s) == 1 for s in sets.values())
    for kind in {r.kind for r in chosen}:
        for which in question_sets.SETS:
            own = sorted((r for r in chosen if r.kind == kind and r.set_ == which), key=lambda r: r.place)
            assert [r.place for r in own] == list(range(1, len(own) + 1)) and len(own) <= 12
            assert [r.priority for r in own] == sorted((r.priority for r in own), reverse=True)
    again = question_sets.allocate(spark.createDataFrame(rows[::-1], SCHEMA), 12).collect()
    assert {(r.cand, r.set_, r.place) for r in again} == {(r.cand, r.set_, r.place) for r in chosen}
    other = question_sets.allocate(spark.createDataFrame(rows, SCHEMA), 12, seed=8).collect()
    assert {(r.cand, r.set_) for r in other} != {(r.cand, r.set_) for r in chosen}


def test_long_chains_are_one_component(spark):
    pairs = [(f"c{i:04d}", f"k{i + d}") for i in range(300) for d in (0, 1)]
    random.Random(1).shuffle(pairs)
    assert question_sets.components(spark.createDataFrame(pairs, "cand string, key string")).select("label").distinct().collect()[0].label == "c0000"


def test_wordings_and_leaks(spark):
    rows = _candidates(40, 500, 3)
    chosen = question_sets.allocate(spark.createDataFrame(rows, SCHEMA), 5)
    words = question_sets.worded(chosen).collect()
    assert len(words) == 2 * chosen.count() and len({r.query_id for r in words}) == len(words)
    own = chosen.withColumn("query_id", F.col("cand"))
    keys = own.select("query_id", F.explode("keys").alias("key"))
    assert question_sets.leaks(own, keys).isEmpty()
    swapped = own.withColumn("set_", F.when(F.col("place") % 2 == 0, "dev").otherwise("heldout"))
    shared = spark.createDataFrame([(r.cand, "one fact") for r in chosen.collect()], "query_id string, key string")
    assert question_sets.leaks(swapped, shared).collect()[0].key == "one fact"
    assert question_sets.allocate(spark.createDataFrame([], SCHEMA), 5).isEmpty()
