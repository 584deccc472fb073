"""Operators on toy inputs whose results can be worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import markup, questions
from docloom.functions import text as T
from docloom.operators import bundle, chunking, evaluation, gold, graph, metadata, ranking, store
from docloom.sources import markdown


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'double' if isinstance(values[n], float) else 'string'}" for n in names))
    return frame.select(column.alias("x")).first().x


def test_stemming(spark):
    assert " ".join(one(spark, T.normalize_stem(F.col("t")), t="Which Stores have_fuel? categories express hours has")) == "which store have fuel category express hour has"
    assert one(spark, T.normalize_stem(F.col("t")), t=None) == []


def test_identifiers(spark):
    assert one(spark, T.tokenize_ident(F.col("t")), t="Store-S07 v1.2, x_y.") == ["store-s07", "v1.2", "x_y"]


def test_rank_metrics(spark):
    runs = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "a", 4)], "query_id string, doc string, rank int")
    qrels = spark.createDataFrame([("q", d) for d in "abcd"], "query_id string, doc string")
    r = evaluation.ir_metrics(runs, qrels).first()
    assert (r.p1, r.p10, r.r10, r.mrr10) == (1, 0.2, 0.5, 1) and r.f110 == pytest.approx(2 * 0.2 * 0.5 / 0.7, abs=1e-6)
    ideal = sum(1 / np.log2(i + 1) for i in range(1, 5))
    assert r.ndcg10 == pytest.approx((1 + 1 / np.log2(4)) / ideal, abs=1e-6)


def test_collapse(spark):
    ranked = spark.createDataFrame([("q", d, i) for i, d in enumerate("aabcbd", 1)], "query_id string, doc string, rank int")
    assert [r.doc for r in ranking.collapse(ranked, "doc", 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_fusion_counts_a_repeated_item_once(spark):
    rows = [("q", "r", "a", 1), ("q", "r", "a", 2), ("q", "r", "b", 3), ("q", "s", "b", 1)]
    got = {r.doc: r.score for r in ranking.rrf(spark.createDataFrame(rows, "query_id string, ranking string, doc string, rank int"), 60).collect()}
    assert got == {"a": round(1 / 61, 9), "b": round(1 / 63 + 1 / 61, 9)}


def test_bm25_ties_by_id_as_text(spark):
    units = spark.createDataFrame([(9, "x y"), (10, "x y"), (1, "z")], "unit_id int, text string")
    asked = spark.createDataFrame([(1, "x x"), (2, "")], "query_id int, text string")
    assert [(r.query_id, r.unit_id) for r in ranking.bm25(units, asked, 5).orderBy("query_id", "rank").collect()] == [(1, "10"), (1, "9")]
    with pytest.raises(ValueError):
        ranking.bm25(units, asked, 0)


def test_dense_blocks_agree(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(50)], "unit_id int, embedding array<float>")
    asked = rows.where("unit_id < 7").withColumnRenamed("unit_id", "query_id")
    def best(block):
        return sorted(ranking.top(ranking.dense(rows, asked, 3, "unit_id", block=block), 3, F.col("score").desc(), F.col("unit_id")).collect())

    assert best(2) == best(100)


def test_flat_chunks_cover_by_the_rule(spark):
    for n in (0, 1, 5, 11, 30):
        words = [f"w{i}" for i in range(n)]
        for size, overlap in ((5, 0), (5, 2), (7, 6)):
            docs = spark.createDataFrame([(1, " ".join(words))], "doc int, text string")
            native = [r.text for r in chunking.chunk_flat(docs, size, overlap).orderBy("ord").collect()]
            assert native == chunking.token_windows(words, lambda t: len(t.split()), size, overlap)


def test_token_windows_are_the_longest_runs_that_fit():
    rng = np.random.default_rng(5)
    for _ in range(60):
        words = ["x" * int(k) for k in rng.integers(1, 9, rng.integers(1, 40))]
        cost, size, overlap = lambda t: len(t), 20, 7
        want, start, covered = [], 0, 0
        while start < len(words):
            end = max([e for e in range(start + 1, len(words) + 1) if cost(" ".join(words[start:e])) <= size], default=start + 1)
            if end > covered:
                want.append(" ".join(words[start:end]))
                covered = end
            if end == len(words):
                break
            back = max([n for n in range(1, end - start) if cost(" ".join(words[end - n : end])) <= overlap], default=0)
            start = max(end - back, start + 1)
        assert chunking.token_windows(words, cost, size, overlap) == want


def test_evidence_takes_first_sections_first(spark):
    sections = spark.createDataFrame([("a", 0), ("a", 5), ("b", 1), ("b", 2), ("b", 9)], "doc string, ord int")
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "query_id string, doc string, rank int")
    assert [(r.doc, r.ord) for r in chunking.evidence_order(ranked, sections).orderBy("position").collect()] == [("b", 1), ("a", 0), ("b", 2), ("a", 5), ("b", 9)]


def test_packing_cuts_the_last_passage(spark):
    rows = spark.createDataFrame([("q", 1, "p", "a b c"), ("q", 2, "p", "d e f g h"), ("q", 3, "p", "i")], "query_id string, position int, path string, text string")
    got = chunking.pack_context(rows, 10).orderBy("position").collect()
    assert [(r.text, r.tokens) for r in got] == [("a b c", 5), ("d e f", 5)]


def test_packing_by_a_tokenizer_counts_the_whole_context(spark):
    rows = spark.createDataFrame([("q", 1, "p", "abc"), ("q", 2, "p", None), ("q", 3, "p", "defgh"), ("q", 4, "p", "i"), ("r", 1, "p", "abc")], "query_id string, position int, path string, text string")
    got = {r.query_id: r for r in chunking.pack_context_tokens(rows, list, "".join, 28).collect()}
    assert got["q"].context == "\nSource: p\nabc\nSource: p\ndef" and got["q"].tokens == 28 and got["q"].clipped and got["q"].n_passages == 2
    assert got["r"].context == "\nSource: p\nabc" and not got["r"].clipped
    assert chunking.pack_context_tokens(rows, list, "".join, 5).first().context == ""
    with pytest.raises(ValueError):
        chunking.pack_context_tokens(rows, list, "".join, 0)


def test_bundles_are_checked(spark):
    docs = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    chunks = spark.createDataFrame([(1, "a.md", "struct", 0, "x"), (2, "a.md", "flat", 0, "x"), (3, "gone.md", "struct", 0, "x")], "chunk_id int, path string, policy string, ord int, text string")
    edges = spark.createDataFrame([("a.md", "b.md", "prose", "authored"), ("a.md", "gone.md", "prose", "authored"), ("b.md", "a.md", "prose", "extracted")], "src string, dst string, kind string, provenance string")
    vectors = lambda *rows: spark.createDataFrame(list(rows), "chunk_id int, path string, vector array<float>")
    loaded = bundle.load(docs, chunks, edges, vectors((1, "a.md", [1.0])))
    assert [tuple(r) for r in loaded["edges"].collect()] == [("a.md", "b.md", "prose")]
    assert {(r.chunk_id, r.vector is None) for r in loaded["chunks"].collect()} == {(1, False), (2, True)}
    for bad in (vectors((1, "a.md", None)), vectors((1, "b.md", [1.0])), vectors((1, "a.md", [1.0]), (9, "a.md", [1.0]))):
        with pytest.raises(ValueError, match="embed the bundle again"):
            bundle.load(docs, chunks, edges, bad)
    with pytest.raises(ValueError, match="no documents"):
        bundle.load(docs.limit(0), chunks, edges, vectors((1, "a.md", [1.0])))


def test_expansion_does_not_sum_boosts(spark):
    ranked = spark.createDataFrame([("q", p, s, i) for i, (p, s) in enumerate([("a", 10.0), ("b", 9.5), ("c", 9.0), ("x", 8.0)], 1)], "query_id string, path string, score double, rank int")
    edges = spark.createDataFrame([("hub", p, "child") for p in "abc"], "src string, dst string, kind string")
    order = [r.path for r in graph.expand_weighted(ranked, edges).orderBy("rank").collect()]
    assert order.index("hub") > order.index("x")


def test_expanding_documents(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", float(20 - i), i + 1) for i in range(20)], "query_id string, path string, score double, rank int")
    edges = spark.createDataFrame([("d0", "d19", "child"), ("d1", "d18", "child")], "src string, dst string, kind string")
    assert [r.path for r in graph.expand_docs(ranked, edges, k=10).orderBy("rank").collect()] == ["d0", "d1", "d2", "d3", "d4", "d19", "d18", "d5", "d6", "d7"]


def test_budgeted_walk_lets_a_linked_unit_in(spark):
    units = spark.createDataFrame([(f"c{i:02}", f"d{i}") for i in range(12)], "unit_id string, path string")
    ranked = units.withColumn("rank", F.substring("unit_id", 2, 2).cast("int") + 1).withColumn("query_id", F.lit("q")).where("rank <= 10")
    edges = spark.createDataFrame([("d0", "d11", "child")], "src string, dst string, kind string")
    got = [r.unit_id for r in graph.budgeted(ranked, units, edges).orderBy("rank").collect()]
    assert got[5] == "c11" and len(got) == 10


def test_parent_chain_tells_loops(spark):
    docs = spark.createDataFrame([(p,) for p in "abxy"], "path string")
    edges = spark.createDataFrame([("a", "b", "child"), ("x", "y", "child"), ("y", "x", "child")], "src string, dst string, kind string")
    assert {r.path: r.ok for r in graph.parent_chain(docs, edges).collect()} == {"a": True, "b": True, "x": False, "y": False}


def test_parent_chains_may_be_long(spark):
    docs = spark.range(60).select(F.format_string("n%02d", "id").alias("path"))
    edges = spark.range(59).select(F.format_string("n%02d", "id").alias("src"), F.format_string("n%02d", F.col("id") + 1).alias("dst"), F.lit("child").alias("kind"))
    edges = edges.unionByName(spark.createDataFrame([("gone", "lost", "child")], "src string, dst string, kind string"))
    got = {r.path: (r.root, r.depth, r.ok) for r in graph.parent_chain(docs.unionByName(spark.createDataFrame([("lost",)], "path string")), edges).collect()}
    assert got.pop("lost") == ("gone", 1, False) and got == {f"n{i:02}": ("n00", i, True) for i in range(60)}


def test_filters_of_missing_and_unlike_fields(spark):
    fields = spark.createDataFrame([("p", "store", "year", "int", ["2004"], 2004.0), ("q", "store", "region", "str", ["West"], None), ("r", "store", "start", "date", ["2025-11-20"], None), ("r", "store", "end", "date", ["2026-01-10"], None)], "path string, doc_type string, field string, kind string, vals array<string>, num double")
    rows = [("a", "year", "!=", [], [1999.0]), ("b", "region", "not_in", ["East"], []), ("c", "year", "==", ["2004"], []), ("d", "start", "month_overlap", [], [12.0]), ("e", "start", "start_month", [], [11.0]), ("f", "year", "between", [], [2000.0, 2004.0])]
    filters = spark.createDataFrame([(q, "store", 0, f, op, s, x) for q, f, op, s, x in rows], "query_id string, doc_type string, n int, field string, op string, s array<string>, x array<double>")
    got = {(r.query_id, r.path) for r in metadata.apply_filters(fields, filters).collect()}
    assert got == {("a", "p"), ("b", "q"), ("e", "r"), ("f", "p")}  # months do not wrap over a year's end


@pytest.mark.parametrize("question, kind", [("Which Mountain region locations first opened in 2004?", "store"), ("What promos are there", "promotion"), ("Where do I go", "store"), ("Tell me the policy", None), ("list all of the vendors", "supplier"), (None, None), ("", None), ("Which of our stores of the region", "region"), ("name a b c d e f store", "store"), ("which region which store", "region")])
def test_target_types(spark, question, kind):
    assert one(spark, questions.target_type(F.col("q").cast("string")), q=question) == kind


KINDS = {
    "store": {"region": "str", "store_status": "str", "opened_year": "int", "sq_ft": "int", "has_pharmacy": "bool", "has_fuel": "bool"}, "supplier": {"country": "str"},
    "promotion": {"formats": "list", "start": "date", "end": "date", "discount_pct": "int"}, "department": {"dept_group": "str"},
}
VALUES = {"store": {"region": ["Coastal", "Mountain"], "store_status": ["closed", "open"]}, "supplier": {"country": ["Canada", "Mexico"]}, "promotion": {"formats": ["express", "supercenter"]}, "department": {"dept_group": ["food", "health"]}}


def kinds_and_values(spark):
    kinds = spark.createDataFrame([(t, f, k) for t, own in KINDS.items() for f, k in own.items()], "doc_type string, field string, kind string")
    return kinds, spark.createDataFrame([(t, f, v) for t, own in VALUES.items() for f, v in own.items()], "doc_type string, field string, vals array<string>")


def test_questions_become_filters(spark):
    asked = {
        "Which Mountain region locations first opened in 2004?": [("region", "in", ["Mountain"]), ("opened_year", "==", [2004])],
        "List all suppliers outside Canada": [("country", "not_in", ["Canada"])], "Where can I buy fuel?": [("has_fuel", "==", [1])], "What promotions start in November?": [("start", "start_month", [11])],
        "Which stores have a pharmacy but no gas pumps and more than 100,000 square feet?": [("has_fuel", "==", [0]), ("has_pharmacy", "==", [1]), ("sq_ft", ">", [100000])],
        "Name the departments in the food group": [("dept_group", "in", ["food"])], "How tall is it?": [], "stores opened between 1999 and 2005": [("opened_year", "between", [1999, 2005])],
        "Which promotions give at least 20% only at express stores?": [("discount_pct", ">=", [20]), ("formats", "only", ["express"])],
        "Which stores are closed or open?": [], "stores open since 1980, 1990 or later, before 2001 and in 1999": [("opened_year", "<", [2001]), ("opened_year", "==", [1999]), ("opened_year", ">=", [1980]), ("opened_year", ">=", [1990])],
        "promotions that end in May or June, 5% to 10 percent": [("discount_pct", "between", [5, 10]), ("end", "end_month", [5]), ("end", "end_month", [6])],
        "promotions around July": [("start", "month_overlap", [7])], "stores of 1999": [], "stores not closed": [("store_status", "not_in", ["closed"])],
    }
    rows = spark.createDataFrame([*((t, t) for t in asked), ("null", None), ("empty", "")], "query_id string, text string")
    got = {t: [] for t in asked}
    for r in questions.parse_filters(rows, *kinds_and_values(spark)).collect():
        got[r.query_id].append((r.field, r.op, r.s or r.x))
    assert {t: sorted(own, key=str) for t, own in got.items()} == {t: sorted(own, key=str) for t, own in asked.items()}


def test_model_filters_are_validated(spark):
    answers = {
        "good": 'x {"type": "store", "filters": [{"field": "sq_ft", "op": ">", "value": "1,000"}, {"field": "has_fuel", "op": "==", "value": "no"}, {"field": "sq_ft", "op": "~"}, 5, {"field": "region", "op": "in", "value": "East"}]} {',
        "months": '{broken {"type": "promotion", "filters": [{"field": "x", "op": "end_month", "value": "4"}, {"field": "discount_pct", "op": "between", "value": [5]}, {"field": "discount_pct", "op": "between", "value": [5, "1,000"]}, {"field": "discount_pct", "op": "<", "value": "x"}]}',
        "null": None, "words": "no JSON", "planet": '{"type": "planet", "filters": []}', "first": '{} {"type": "store", "filters": []}', "text": '{"type": "store", "filters": "x"}', "false": '{"type": "store", "filters": [{"field": "has_fuel", "op": "!=", "value": false}]}',
    }
    found = questions.model_filters(spark.createDataFrame(list(answers.items()), "query_id string, raw string"), kinds_and_values(spark)[0])
    got = sorted((r.query_id, r.doc_type, r.field, r.op, r.s, r.x) for r in found.collect())
    assert got == [
        ("false", "store", "has_fuel", "!=", [], [0.0]), ("good", "store", "has_fuel", "==", [], [0.0]), ("good", "store", "region", "in", ["East"], []), ("good", "store", "sq_ft", ">", [], [1000.0]),
        ("months", "promotion", "discount_pct", "between", [], [5.0, 1000.0]), ("months", "promotion", "end", "end_month", [], [4.0]),
    ]


def test_holm_blocks_after_the_first_failure(spark):
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    assert {r.name: r.significant for r in evaluation.holm(tests, "family").collect()} == {"a": True, "c": False, "b": False}


def test_kappa(spark):
    k = lambda rows: evaluation.kappa(spark.createDataFrame(rows, "a string, b string")).first()
    assert k([("x", "x"), ("y", "y")]).kappa == 1 and k([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]).kappa == 0 and k([("x", "x")]).kappa == 1
    assert k([]) is None


def test_bootstrap_is_numpys():
    d = np.array([0.1, 0.4, -0.2, 0.3])
    b = d[np.random.default_rng(7).integers(0, 4, (10_000, 4))].mean(axis=1)
    assert evaluation.bootstrap(d)[1:3] == tuple(np.percentile(b, [2.5, 97.5]))


@pytest.mark.parametrize("answer, reference, right", [("It is 12,000 square feet.", "12000 square feet", 1), ("About 120000", "12000", 0), ("From 2025-01-02 until 2025-03-04", "2025-01-02 to 2025-03-04", 1), ("NOT FOUND", "5", 0), ("20 percent off", "20%", 1), ("costs $3.50", "$3.50", 1)])
def test_fact_correct(spark, answer, reference, right):
    assert one(spark, T.fact_correct(F.col("a"), F.col("r")), a=answer, r=reference) == right


def test_set_f1(spark):
    answers = spark.createDataFrame([("q", "alpha and beta"), ("r", "gamma"), ("s", None)], "query_id string, answer string")
    aliases = spark.createDataFrame([(n, n) for n in ("alpha", "beta", "gamma", "delta")], "alias string, name string")
    golds = spark.createDataFrame([("q", "alpha"), ("q", "beta"), ("r", "delta"), ("s", "alpha")], "query_id string, name string")
    assert {r.query_id: r.f1 for r in evaluation.set_f1(answers, aliases, golds).collect()} == {"q": 1.0, "r": 0.0, "s": 0.0}


def test_vector_checks_and_missing_columns(spark):
    chunks = spark.createDataFrame([(1, 1)], "chunk_id int, doc_id int")
    assert store.vector_checks(chunks, chunks).collect()[0].n_bad == 1


def test_gold_recheck(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert {(r.id, r.problem) for r in gold.recheck(a, b, "id").collect()} == {(1, "stale"), (3, "missing")}


MARKDOWN = {
    "links": ("a `x` [l](u.md)\n```\n[no](v.md)\n```\n![img](i.png)", [[16, 34]], ["`x`"], "a `x` l\n```\nno\n```\nimg", [("l", "u.md")]),
    "open": ("```\nopen", [[0, 8]], [], "```\nopen", []),
    "closed by a longer fence with words": ("~~~\na\n``` b\n~~~~ c\nd", [[0, 18]], [], "~~~\na\n``` b\n~~~~ c\nd", []),
    "two fences": ("```\na\n```\n```\nb\n```", [[0, 9], [10, 19]], [], "```\na\n```\n```\nb\n```", []),
    "indented is no fence": (" ```\na", [], [], " ```\na", []),
    "runs of backticks": ("`a ``b`` c``d`", [], ["`a ``b`` c``d`"], "`a ``b`` c``d`", []),
    "an odd backtick": ("`a ``b``", [], ["``b``"], "`a ``b``", []),
    "references": ("A [ref][x] and [x] and [y] and [x](z).\n\n[x]: http://x.org\nend", [], [], "A ref and x and [y] and x.\n\nend", [("x", "z")]),
    "tags": ('<a href="u">in</a> <B>bold</b> `<b>kept</b>` <img src="i"> <div\nclass=x>y</div> <br/>', [], ["`<b>kept</b>`"], "in bold `<b>kept</b>`  y ", []),
    "no tags": ("<script>var a = 1;</script>x < 5 and <job_id> and <b", [], [], "x < 5 and <job_id> and <b", []),
    "titles": ('[a](b "t") [c]( d) [k](l)[m](n) [x] (y) [z]() [p [q](r)', [], [], "a c km [x] (y) [z]() p [q", [("a", "b"), ("k", "l"), ("m", "n"), ("p [q", "r")]),
    "null": (None, [], [], None, []),
    "empty": ("", [], [], "", []),
}


def test_code_links_and_tags(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in MARKDOWN.items()], "id string, text string")
    text = F.col("text")
    found = rows.select("id", markup.fence_regions(text).alias("fences"), markup.inline_code_texts(text).alias("code"), markup.reduce_links(text).alias("reduced"), markup.extract_links(text).alias("links"))
    got = {r.id: (r.fences, r.code, r.reduced, [(x.words, x.href) for x in r.links]) for r in found.collect()}
    assert got == {k: v[1:] for k, v in MARKDOWN.items()}


def test_markdown_collection(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "index.md").write_text("---\ntype: home\ntitle: Home\n---\nSee [a](/a/b.md), [web](https://x.org) and [self](index.md).\n")
    (tmp_path / "a" / "b.md").write_text("---\ntype: page\ntitle: B\nparent: index.md\ntags: [x, y]\nsize: 3\n---\n[up](../index)\n")
    docs, edges = markdown.ingest(spark, str(tmp_path))
    row = docs.where("path = 'a/b.md'").first()
    assert (row.doc_type, row.title, row.tags, row.breadcrumb, row.depth) == ("page", "B", ["x", "y"], ["a"], 1) and '"size":"3"' in row.fm
    assert {tuple(r) for r in edges.collect()} == {("index.md", "a/b.md", "child"), ("index.md", "a/b.md", "prose"), ("a/b.md", "index.md", "prose")}
    (tmp_path / "c.md").write_text("[gone](/nope.md)")
    with pytest.raises(ValueError, match="unresolved"):
        markdown.ingest(spark, str(tmp_path))


def test_exchange_files(spark, tmp_path):
    chunks = spark.createDataFrame([(2, 1, 1, "b"), (1, 1, 0, "a")], "chunk_id int, doc_id int, ord int, text string")
    markdown.export_chunks(chunks, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert [r.chunk_id for r in back.collect()] == [1, 2]
    vectors = markdown.embed(back, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert vectors.schema["vector"].dataType.simpleString() == "array<float>" and vectors.count() == 2
    markdown.write_csv(back.drop("doc_id"), str(tmp_path / "report"), "# made by a test")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["# made by a test", "chunk_id,text", "1,a", "2,b"]
    markdown.write_jsonl(back, str(tmp_path / "rows"))
    assert markdown.read_jsonl(spark, str(tmp_path / "rows"), "chunk_id int, text string").count() == 2


def test_stream_counts_are_the_batchs(spark, tmp_path):
    from docloom.streaming.events import windowed_counts

    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sorted(spark.table("counted").collect()) == sorted(windowed_counts(rows).collect())


def test_compare_keeps_lanes_apart(spark):
    from docloom.operators.arms import compare

    sections = spark.createDataFrame([("a", 0, "one two"), ("b", 0, "three")], "doc string, ord int, text string")
    good = lambda asked: asked.select("query_id", F.explode(F.array(F.struct(F.lit("b").alias("doc"), F.lit(1).alias("rank")))).alias("x")).select("query_id", "x.*")
    got = {r.lane: r for r in compare(spark, "why?", {"good": good, "bad": lambda asked: asked.select("nothing")}, sections, lambda q, d: q + d).collect()}
    assert got["good"].sources == ["b"] and got["good"].answer == "why?[1] b\nthree" and got["good"].error is None
    assert got["bad"].error and got["bad"].answer is None


def test_all_arms_in_one_plan(spark):
    from docloom.operators.arms import run_arms

    docs = spark.createDataFrame([("r.md", "region", "West", "", [], None), ("r/s.md", "store", "Shop", "", [], "open"), ("r/t.md", "store", "Other Shop", "", [], "closed")], "path string, doc_type string, title string, description string, tags array<string>, status string")
    fields = spark.createDataFrame([("r/s.md", "store", "year", "int", ["2004"], 2004.0), ("r/t.md", "store", "year", "int", ["1999"], 1999.0)], "path string, doc_type string, field string, kind string, vals array<string>, num double")
    edges = spark.createDataFrame([("r.md", "r/s.md", "child"), ("r.md", "r/t.md", "child")], "src string, dst string, kind string")
    asked = spark.createDataFrame([("q", "which shop in the west")], "query_id string, text string")
    filters = spark.createDataFrame([("q", "store", 0, "year", "<", [], [2000.0])], "query_id string, doc_type string, n int, field string, op string, s array<string>, x array<double>")
    wanted = spark.createDataFrame([("q", "store")], "query_id string, doc_type string")
    dense = spark.createDataFrame([("q", "r/t.md", 0.9, 1), ("q", "r/s.md", 0.5, 2)], "query_id string, path string, score double, rank int")
    got = run_arms(asked, docs, fields, edges, filters, wanted, {"R0": dense}).where("rank = 1").collect()
    first = {r.arm: r.path for r in got}
    assert set(first) == {"R0", "R2", "R2s", "R3s", "R5p", "R6f", "R7f", "R7h"} and first["R6f"] == "r/t.md" and first["R0"] == "r/t.md" and first["R5p"].startswith("r/")


def test_contained_items(spark):
    docs = {1: "the red fox runs the red", 2: "a red foxes", 3: "x", 4: None, 5: "of the of the of"}
    asked = {1: "red fox runs", 2: "ed fox", 3: "fox", 4: "x", 5: "", 6: "e red fox runs th", 7: "the of the", 8: "zzz yyy xxx", 9: None, 10: "of"}
    units = spark.createDataFrame(list(docs.items()), "unit_id int, text string")
    found = gold.containment(units, spark.createDataFrame(list(asked.items()), "query_id int, text string"))
    want = {(d, q) for d, t in docs.items() for q, x in asked.items() if t and x and x in t}
    assert sorted((r.unit_id, r.query_id) for r in found.collect()) == sorted(want)


def test_fingerprints_and_chunk_replacement(spark):
    files = spark.createDataFrame([(f"d/{i}.md", bytes([i])) for i in range(30)], "path string, content binary")
    one_ = store.fingerprint_levels(files, 1).first()
    assert one_ == store.fingerprint_levels(files.repartition(7), 1).first() and one_.n_files == 30
    assert one_.sha256 != store.fingerprint_levels(files.where("path <> 'd/3.md'"), 1).first().sha256
    stored = spark.createDataFrame([(1, "flat", 0, "a"), (1, "struct", 0, "b"), (2, "flat", 0, "c")], "doc_id int, policy string, ord int, text string")
    new = spark.createDataFrame([("x", 0, 1, "flat"), ("y", 1, 1, "flat")], "text string, ord int, doc_id int, policy string")
    assert {tuple(r) for r in store.replace_chunks(stored, new).collect()} == {(1, "flat", 0, "x"), (1, "flat", 1, "y"), (1, "struct", 0, "b"), (2, "flat", 0, "c")}


def _page(n: int) -> str:
    """A page of n lines, each with a link, tags, a run of inline code and now and then a fence, and openings that nothing closes."""
    lines = [f"see [item {i}](p{i}.md \"t\") and <b class='x'>bold</b> <script> ![pic](p.png) `code <i>{i}</i>` <a\nhref='x'>y</a> [text]" for i in range(n)]
    return "\n".join(lines[: n // 2] + ["```", "<b>[in](code.md)</b>", "```"] * (n // 20) + lines[n // 2 :])


def test_markup_functions_are_linear(spark):
    """Ten times the page takes about ten times as long, and a page of 10,000 links and more tags a few seconds."""
    import time

    def seconds(function, n: int) -> float:
        page = spark.createDataFrame([(_page(n),)], "text string").cache()
        page.count()
        began = time.time()
        page.select(F.hash(function(F.col("text")))).collect()
        return time.time() - began

    for function in (markup.extract_links, markup.html_strip, markup.inline_code_texts, markup.fence_regions):
        seconds(function, 100)
        small, large = min(seconds(function, 1_000) for _ in range(2)), seconds(function, 10_000)
        assert large < 25 * max(small, 0.1), (function.__name__, small, large)
        assert large < 20


def test_links_of_a_long_page(spark):
    n = 3_000
    found = spark.createDataFrame([(_page(n),)], "text string").select(F.explode(markup.extract_links(F.col("text"))).alias("x")).select("x.*").collect()
    assert [(r.words, r.href) for r in found] == [(f"item {i}", f"p{i}.md") for i in range(n)]


def test_silent_elements_and_open_ones(spark):
    cases = ["a<script>x</script>b", "a<SCRIPT type='t'>x<b>y</Script >z</script>b", "a<script>x", "<style>s</style><script>t</script>u", "x</script>y<scripts>z</script>", "<script\nsrc='q'></script>end"]
    want = ["ab", "ab", "ax", "u", "xy<scripts>z", "end"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(markup.html_strip(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == want


def test_counted_draws_are_a_bootstrap(spark):
    """Intervals near numpy's, one weight a query in all groups, and nothing that depends on partitions."""
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(0.05, 0.2, 120).round(6), "b": rng.normal(0.0, 0.2, 120).round(6), "c": np.zeros(1)}
    rows = [(g, i, float(v)) for g, vs in values.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "arm string, query_id long, value double")
    found = {r.arm: r for r in evaluation.resampled(frame, ["arm"]).collect()}
    again = {r.arm: r for r in evaluation.resampled(frame.repartition(7), ["arm"]).collect()}
    assert found == again
    for g in "ab":
        mean, low, high, p = evaluation.bootstrap(values[g])
        assert found[g].n == 120 and abs(found[g]["mean"] - mean) < 1e-6
        assert abs(found[g].ci_low - low) < 0.006 and abs(found[g].ci_high - high) < 0.006 and abs(found[g].p - p) < 0.02
    assert (found["c"].ci_low, found["c"].ci_high, found["c"].p) == (0.0, 0.0, 1.0)
    twins = frame.where("arm = 'a'").unionByName(frame.where("arm = 'a'").withColumn("arm", F.lit("z")))
    one, two = evaluation.resampled(twins, ["arm"]).collect()
    assert one[1:] == two[1:]


def test_poisson_steps():
    u = np.random.default_rng(1).integers(0, 2**32, 200_000)
    weights = sum((u >= t).astype(int) for t in evaluation.poisson_steps())
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
