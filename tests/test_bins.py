"""Searches by bins and blocks: the results of one piece, however the rows are dealt, and no more rows than asked for."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import questions
from docloom.operators import gold, graph, metadata, ranking


def _plain_bm25(units, questions, k):
    tokens = {u: (t or "").lower().split() for u, t in units}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = []
    for q, text in questions:
        found = []
        for u, t in tokens.items():
            tf = Counter(t)
            score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in set((text or "").lower().split()) if w in tf)
            if score > 0:
                found.append((-round(score, 6), str(u)))
        out += [(q, u, -s, place) for place, (s, u) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bin_units, block", [(4096, 1024), (7, 2)])
def test_bm25_of_bins_and_blocks_is_bm25_of_all_units(spark, monkeypatch, bin_units, block):
    monkeypatch.setattr(ranking, "BIN_UNITS", bin_units)
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "ENTRIES", 40 if block == 2 else 2_000_000)
    # word "all" is in every unit, and ten units are equal
    units = [(i, f"all w{i % 5} w{i % 7} w{i % 11} " * (1 + i % 3)) for i in range(60)] + [(100 + i, "all same text") for i in range(10)] + [(200, None), (201, "")]
    questions = [(0, "all"), (1, "all w1 w3"), (2, "same same w2"), (3, "none"), (4, None), (5, "w10 text")]
    found = ranking.bm25(spark.createDataFrame(units, "unit_id long, text string"), spark.createDataFrame(questions, "query_id long, text string"), 8)
    assert sorted((r.query_id, r.unit_id, r.score, r["rank"]) for r in found.collect()) == _plain_bm25(units, questions, 8)


def test_a_bin_gives_k_units_a_question_whatever_is_equal(spark):
    held = pa.table({"unit_id": [str(i) for i in range(500)], "ranking": [""] * 500, "terms": [["all", "same"]] * 500})
    asked = pa.table({"ranking": [""] * 3, "query_id": [0, 1, 2], "avg_terms": [2.0] * 3, "terms": [["all"], ["same"], ["all", "same"]], "idf": [[0.1], [0.1], [0.1, 0.1]]})
    found = ranking._best_part([""], pa.int64(), 5, ranking.K1, ranking.B)(held, asked)
    assert found.num_rows == 15 and sorted(set(found["unit_id"].to_pylist())) == ["0", "1", "10", "100", "101"]


@pytest.mark.parametrize("group", [None, "doc"])
def test_dense_queries_do_not_pass_the_driver(spark, monkeypatch, group):
    vectors = [(i, i % 3, [float(i % 5), float(i % 7 - 3)]) for i in range(60)]
    asked = [(i, v) for i, _, v in vectors if i % 9 == 0]
    rows = spark.createDataFrame(vectors, "unit_id long, doc long, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6) + 0.0
    monkeypatch.setattr(ranking, "BIN_VECTORS", 7)
    monkeypatch.setattr(ranking, "ENTRIES", 20)
    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(type(rows), name, lambda *_: pytest.fail("rows reach the driver"))
    found = ranking.dense_docs(rows, queries, "doc", "unit_id", 2) if group else ranking.dense_topk(rows, queries, 4)
    monkeypatch.undo()
    want = []
    for q, v in asked:
        order = sorted((-score(v, e), u, d) for u, d, e in vectors)
        if group:
            best = sorted(min(x for x in order if x[2] == d) for d in range(3))[:2]
            want += [(q, d, -s, place) for place, (s, _, d) in enumerate(best, 1)]
        else:
            want += [(q, u, -s + 0.0, place) for place, (s, u, _) in enumerate(order[:4], 1)]
    got = sorted((r.query_id, r["doc" if group else "unit_id"], r.score, r["rank"]) for r in found.collect())
    assert got == sorted(want)


def test_a_dense_task_holds_a_slice_of_its_scores(monkeypatch):
    monkeypatch.setattr(ranking, "ENTRIES", 50)
    schema = pa.schema([("query_id", pa.int64()), ("doc", pa.int64()), ("unit_id", pa.int64()), ("score", pa.float64())])
    rows = pa.table({"doc": [1, 0, 1, 0], "unit_id": [3, 2, 1, 0], "embedding": [[1.0], [2.0], [1.0], [2.0]]})
    asked = pa.table({"query_id": list(range(30)), "embedding": [[1.0]] * 30})
    found = ranking._dense_part(None, "doc", ["doc", "unit_id"], schema)(rows, asked)
    assert found.num_rows == 60 and {(r["doc"], r["unit_id"], r["score"]) for r in found.to_pylist()} == {(0, 0, 2.0), (1, 1, 1.0)}


def test_shared_shingles_are_not_broadcast(spark):
    from docloom.operators import store

    left = spark.createDataFrame([(1, 10, "abcdefghij"), (1, 11, "zzzz"), (2, 12, "12345678"), (None, 13, "abcdefgh")], "doc long, id long, text string")
    right = spark.createDataFrame([(1, 20, "xxcdefghijyy"), (1, 21, "abcdefgxhij"), (2, 22, "abcdefghij"), (None, 23, "abcdefgh"), (2, 24, "x12345678"), (2, 25, None)], "doc long, id long, text string")
    found = store.shared_shingles(left, right)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 20), (2, 12, 24)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_set_f1_of_many_names_with_one_first_word(spark):
    """Each answer names thousands of suppliers; no text may be paired with every alias."""
    from docloom.operators import evaluation

    names = [f"Supplier#{i:05d}" for i in range(3000)]
    answers = [(q, "They are " + "; ".join(names[q * 1000 : (q + 1) * 1000]) + " and x.Supplier#00001, the (Acme) Inc.") for q in range(3)] + [(3, "v1.Supplier#00001 Supplier#000012"), (4, "Old Co.; supplier#00002")]
    aliases = [(n, n) for n in names] + [("(Acme)", "Acme"), ("Old  Co.", "Old"), ("", "nothing")]
    gold = [(q, n) for q in range(3) for n in names[q * 1000 : (q + 1) * 1000]] + [(3, names[1]), (4, names[2]), (4, "Old")] + [(0, "Acme")]
    found = evaluation.set_f1(spark.createDataFrame(answers, "query_id long, answer string"), spark.createDataFrame(aliases, "alias string, name string"), spark.createDataFrame(gold, "query_id long, name string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (alias" in plan  # whole names meet by an equi-join of names
    near = round(2 * (1000 / 1001) / (1000 / 1001 + 1), 6)
    assert {r.query_id: r.f1 for r in found.collect()} == {0: 1.0, 1: near, 2: near, 3: 0.0, 4: 1.0}


def test_pairs_that_share_buckets_are_never_rows(spark):
    rows = [(i, [i / 100, 0.0], [i // 50, i % 2]) for i in range(100)]
    held = spark.createDataFrame(rows, "unit_id long, embedding array<float>, codes array<int>")
    asked = held.where("unit_id % 25 = 0").withColumnRenamed("unit_id", "query_id")
    found = ranking.bucketed_topk(held, asked, 3, 0.3)
    want = []
    for q, (x, _), a in rows[::25]:
        near = sorted((round(abs(x - y), 6), u) for u, (y, _), b in rows if (a[0] == b[0] or a[1] == b[1]) and abs(x - y) < 0.3)[:3]
        want += [(q, u, d, place) for place, (d, u) in enumerate(near, 1)]
    assert sorted((r.query_id, r.unit_id, r.distance, r["rank"]) for r in found.collect()) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_filters_join_no_field_rows_and_put_no_field_in_one_task(spark):
    fields = spark.range(4000).selectExpr("concat('o/', id) as path", "'promotion' as doc_type", "explode(array('start', 'end')) as field", "id").selectExpr(
        "path", "doc_type", "field", "'date' as kind", "array(concat('2024-', lpad(1 + (id + if(field = 'end', 2, 0)) % 12, 2, '0'), '-01')) as vals", "cast(null as double) as num").cache()
    filters = spark.createDataFrame([("a", "promotion", 0, "start", "month_overlap", [], [3.0]), ("b", "promotion", 0, "start", "start_month", [], [3.0]), ("b", "promotion", 1, "end", "end_month", [], [5.0]), ("c", "promotion", 0, "end", "end_month", [], [1.0]), ("c", "promotion", 1, "start", "month_overlap", [], [11.0])],
                                    "query_id string, doc_type string, n int, field string, op string, s array<string>, x array<double>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = metadata.apply_filters(fields, filters)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        rows = {(r.query_id, r.path) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    month = lambda i, more=0: 1 + (i + more) % 12
    tests = {"a": lambda i: month(i) <= 3 <= month(i, 2), "b": lambda i: month(i) == 3, "c": lambda i: False}
    assert rows == {(q, f"o/{i}") for q, test in tests.items() for i in range(4000) if test(i)}
    # the fields are read once, and what they meet is dealt by their path
    assert plan.count("InMemoryRelation") == 1 and "_way" in plan


def test_neighbours_of_some_paths_leave_other_links_out_before_grouping(spark):
    edges = spark.createDataFrame([(f"p{i}", f"q{i % 7}", "prose") for i in range(200)] + [("q0", "p0", "prose"), ("p1", "p1", "child"), ("p0", "q0", "prose")], "src string, dst string, kind string")
    paths = spark.createDataFrame([("q0",), ("p1",), ("none",)], "path string")
    found = graph.near(edges, paths)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in graph.undirected(edges).where("src in ('q0', 'p1')").collect()}
    grouped = found._jdf.queryExecution().optimizedPlan().toString()
    assert grouped.index("Aggregate") < grouped.index("LeftSemi")


def test_rankings_that_arms_share_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(rows):
        made.add(1)
        return rows

    base = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2)], "query_id string, path string, score double, rank long").coalesce(1)
    ranked = base.mapInPandas(counted, base.schema)
    edges = spark.createDataFrame([("a", "c", "child")], "src string, dst string, kind string")
    assert {r.path for r in graph.expand_weighted(ranked, edges).collect()} == {"a", "b", "c"}
    assert made.value == 1


def test_contained_items_shuffle_no_texts(spark):
    units = spark.createDataFrame([(i, f"some words before the item number {i % 7} of a list that all hold and more") for i in range(50)], "unit_id int, text string")
    items = spark.createDataFrame([(i, f"before the item number {i} of a list that all hold") for i in range(7)] + [(7, "more"), (8, "the item")], "query_id int, text string")
    found = gold.containment(units, items)
    assert sorted((r.unit_id, r.query_id) for r in found.collect()) == sorted([(i, i % 7) for i in range(50)] + [(i, q) for i in range(50) for q in (7, 8)])
    exchanges = [line for line in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "hashpartitioning" in line]
    assert exchanges and not any("text" in line or "key" in line for line in exchanges)


def test_a_task_of_bm25_holds_few_bins_and_orders_texts_not_words(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BIN_UNITS", 2)
    units = spark.range(90).select(F.col("id").alias("unit_id"), F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text"))
    found = ranking.bm25(units, spark.createDataFrame([(1, "word 7")], "query_id int, text string"), 3)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning(_bin" in line and "_block" in line]
    assert dealt and all(int(line.split("_block")[1].split(", ")[1].split(")")[0]) >= 45 for line in dealt)
    part = next(i for i, line in enumerate(plan) if "FlatMapCoGroupsInArrow" in line)
    assert "Project" in plan[part + 1] and [r.unit_id for r in found.orderBy("rank").collect()] == ["7", "0", "1"]


def test_questions_and_answers_are_parsed_by_many_tasks(spark):
    kinds = spark.createDataFrame([("store", "region", "str"), ("store", "sq_ft", "int")], "doc_type string, field string, kind string")
    values = spark.createDataFrame([("store", "region", ["EAST", "WEST"])], "doc_type string, field string, vals array<string>")
    asked = spark.createDataFrame([(i, f"which stores not in the {x} have more than 5,000 square feet?") for i, x in enumerate(["west", "east"] * 4)], "query_id int, text string").coalesce(1)
    answers = asked.select("query_id", F.lit('{x {"type": "store", "filters": [{"field": "sq_ft", "op": ">", "value": "5,000"}, 7]} {"type": "store"}').alias("raw"))
    for found, want in ((questions.parse_filters(asked, kinds, values), 16), (questions.model_filters(answers, kinds), 8)):
        assert len(found.collect()) == want and {tuple(r.x) for r in found.where("field = 'sq_ft' and op = '>'").collect()} == {(5000.0,)}
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines()
        assert any("REPARTITION_BY_NUM" in line for line in plan)
