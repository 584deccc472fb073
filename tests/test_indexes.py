"""The word index and the vector index against rankings of all units."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import text as T
from docloom.operators import lexical_index, ranking, vector_index

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _files(df) -> int:
    """How many files the rows of a table come from."""
    return df.select(F.input_file_name()).distinct().count()


def _pruned(df, column: str) -> bool:
    """Whether other folders of the column are left out of the scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return f"PartitionFilters: [{column}" in plan or f"PartitionFilters: [isnotnull({column}" in plan


def _texts(n: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.choice((3, 8, 40, 200))))) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(n + 40, None), (n + 41, ""), (n + 42, "rare-word w1 rare-word"), (n + 43, "w0 " * 500)]
    return rows


@pytest.fixture(scope="module")
def words(spark):
    units = spark.createDataFrame(_texts(600), "unit_id long, text string").repartition(3).cache()
    return units, lexical_index.build(units, tile=16)


QUESTIONS = [(0, "w0 w1 w250"), (1, "rare-word"), (2, "w300 w301 w300"), (3, "unknown"), (4, None), (5, ""), (6, "w0"), (7, _texts(6)[5][1])]


@pytest.mark.parametrize("k, first", [(1, 1), (10, 2), (50, 1), (1000, 3)])
def test_index_search_is_the_ranking_of_all_units(spark, words, k, first):
    units, index = words
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.unit_id, r.score) for r in df.collect())
    assert rows(lexical_index.search(index, questions, k, first=first)) == rows(ranking.bm25(units, questions, k))


def test_index_search_in_parts(spark, words, monkeypatch):
    monkeypatch.setattr(lexical_index, "SALTED_TILES", 3)
    units, index = words
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.unit_id, r.score) for r in df.collect())
    assert rows(lexical_index.search(index, questions, 10)) == rows(ranking.bm25(units, questions, 10))


def test_blocks_below_the_bound_and_other_buckets_are_not_read(spark, words):
    _, index = words
    questions = spark.createDataFrame([(1, "rare-word w0")], "query_id long, text string")
    every = lexical_index.bounds(index, questions).count()
    kept, _, buckets = lexical_index.kept_tiles(index, questions, 1)
    assert 0 < kept.count() < every / 4 and len(buckets) <= 2
    assert _files(index.blocks(buckets)) < _files(index.table("blocks")) / 4 and _pruned(index.blocks(buckets), "bucket")
    # bounds hold: no unit of a tile scores more
    weights = lexical_index._weights(index, questions, T.tokenize_ident)[0]
    scored = lexical_index._scored(index, weights, buckets, lexical_index.bounds(index, questions).select("query_id", "tile"))
    over = scored.join(lexical_index.bounds(index, questions), ["query_id", "tile"]).where(F.col("score") > F.col("bound") + 1e-6)
    assert over.isEmpty()


def test_no_pair_of_a_question_and_a_posting_is_a_row(spark, words):
    units, index = words
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    weights, buckets = lexical_index._weights(index, questions, T.tokenize_ident)
    every = lexical_index.bounds(index, questions).select("query_id", "tile")
    whole, best = lexical_index._scored(index, weights, buckets, every), lexical_index._scored(index, weights, buckets, every, 3)
    every_row, best_rows = ({(r.query_id, r.tile, r.ord, r.score) for r in df.collect()} for df in (whole, best))
    assert best_rows < every_row
    # a bin gives a question its three best and what ties with the third
    first = lambda rows, q: sorted((r[3] for r in rows if r[0] == q), reverse=True)[:3]
    assert all(first(best_rows, q) == first(every_row, q) for q in {r[0] for r in every_row})
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(postings" not in plan


def test_index_of_other_tokens_and_of_nothing(spark):
    units = spark.createDataFrame([("a", "Stores store_id"), ("b", "cities"), ("c", "store")], "unit_id string, text string")
    index = lexical_index.build(units, tokens=T.normalize_stem)
    questions = spark.createDataFrame([(1, "city stores")], "query_id long, text string")
    found = lexical_index.search(index, questions, 5, T.normalize_stem).collect()
    assert [(r.unit_id, r.score) for r in found] == [(r.unit_id, r.score) for r in ranking.bm25(units, questions, 5, T.normalize_stem).collect()] and len(found) == 3
    nothing = lexical_index.build(units.where("false"))
    assert lexical_index.search(nothing, questions, 5).isEmpty()


def _vectors(spark, rows: np.ndarray, first: int = 0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rows)], "unit_id long, embedding array<double>")


def _clustered(n: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    rows = centres[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[: n // 3] = rows[0]  # a third of all rows are one vector
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = _clustered(1500)
    frame = _vectors(spark, rows).repartition(4).cache()
    return frame, vector_index.build(frame)


def _keys(df):
    return {(r.query_id, r["rank"], r.unit_id, r.score) for r in df.collect()}


def test_exact_search_is_a_scan_of_all(spark, vectors, monkeypatch):
    frame, index = vectors
    queries = frame.where("unit_id % 50 = 3").withColumnRenamed("unit_id", "query_id")
    assert _keys(vector_index.search(index, queries, 10, exact=True)) == _keys(ranking.dense_topk(frame, queries, 10))
    monkeypatch.setattr(vector_index, "PART", 100)
    parted = vector_index.build(frame, n_cells=12)
    assert parted.cells().agg(F.max("parts")).first()[0] > 3
    assert _keys(vector_index.search(parted, queries, 10, probes=2, exact=True)) == _keys(ranking.dense_topk(frame, queries, 10))


def test_probes_recall_and_read_some_cells_only(spark, vectors):
    frame, index = vectors
    queries = frame.where("unit_id % 50 = 3").withColumnRenamed("unit_id", "query_id")
    found, want = _keys(vector_index.search(index, queries, 10, probes=4)), _keys(ranking.dense_topk(frame, queries, 10))
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    one = vector_index._probe(queries.limit(1), index.cells().orderBy("cell").collect(), 4)
    cells = [r.cell for r in one.collect()]
    assert len(cells) == 4 and _files(index.vectors(cells)) < _files(spark.read.parquet(f"{index.path}/vectors")) / 2 and _pruned(index.vectors(cells), "cell")


def test_queries_with_too_few_vectors_probe_all_cells(spark):
    rows = np.eye(8)
    frame = _vectors(spark, rows)
    index = vector_index.build(frame, n_cells=8)
    queries = frame.where("unit_id < 2").withColumnRenamed("unit_id", "query_id")
    assert _keys(vector_index.search(index, queries, 5, probes=1)) == _keys(ranking.dense_topk(frame, queries, 5))
    assert vector_index.search(index, queries, 20, probes=1).count() == 16


def test_vector_index_refuses_nulls_and_bears_none(spark):
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, None), (2, [1.0])], "unit_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "unit_id long, embedding array<double>"))
    empty = spark.createDataFrame([], "unit_id long, embedding array<double>")
    index = vector_index.build(empty)
    assert vector_index.search(index, _vectors(spark, np.eye(2)).withColumnRenamed("unit_id", "query_id"), 3).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_probed_cells_hold_the_nearest(spark):
    keys = lambda name: {(r.query_id, r.unit_id) for r in catalog.queries()[name](spark, SF).collect()}
    found, exact = keys("ann_cells"), keys("dense_topk")
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
