"""Batched generation, ingest by increments, the bundle source and stored trees."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import digest_tree, generation
from docloom.sources import bundle_source
from docloom.streaming import ingest


def test_batches_keep_their_bounds():
    rng = random.Random(1)
    for _ in range(200):
        rule = generation.Batching(rng.randrange(1, 9), rng.randrange(1, 400), rng.choice((0.0, 0.1, 0.5)))
        lengths = sorted((rng.choice((0, 1, 7, 7, 50, 300, 900)) for _ in range(rng.randrange(0, 60))), reverse=True)
        sizes, at = list(generation.batches(iter(lengths), rule)), 0
        assert sum(sizes) == len(lengths)
        for size in sizes:
            own, at = lengths[at : at + size], at + size
            whole = max(own[0], 1) * size
            assert size <= rule.rows and (size == 1 or whole <= rule.tokens) and whole - sum(own) <= max(rule.padding * whole, 1)


def _counting():
    """Makes a model that tells which one it is and how many rows it saw, and fails on bad prompts."""
    import itertools

    number, made = itertools.count(1), random.random()

    def model(prompts):
        if any("bad" in p.split() for p in prompts):
            raise RuntimeError("bad prompt")
        return [f"{made} {next(number)} {p.split()[-1]}" for p in prompts]

    return model


def test_generation_answers_every_row_and_keeps_errors_apart(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice((3, 3, 3, 3, 20, 200)) + (["bad"] if i % 10 == 0 else []) + [f"end{i}"])) for i in range(400)] + [(7, None), (7, ""), (None, "w end")]
    prompts = spark.createDataFrame(rows, "query_id long, prompt string").repartition(3)
    rule = generation.Batching(8, 800, 0.2)
    found = generation.generate(prompts, _counting, "counting", rule).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.answer is None) == (r.error is not None)
        assert r.batch_rows <= 8 and (r.batch_rows == 1 or r.batch_rows * r.padded <= 800)
    by = {r.query_id: r for r in found if r.query_id not in (7, None)}
    assert all((by[i].error == "RuntimeError: bad prompt") == (i % 10 == 0) for i in by)
    assert all(by[i].answer.endswith(f" end{i}") for i in by if i % 10)
    assert sorted(r.error or "" for r in found if r.query_id == 7 and (r.answer is None)) [-1] == "no prompt"
    waste = sum(r.padded - r.n_tokens for r in found) / max(1, sum(r.padded for r in found))
    assert waste <= 0.2


def test_a_worker_makes_a_model_once(spark):
    prompts = spark.range(300).select(F.col("id").alias("query_id"), F.lit("w end").alias("prompt")).repartition(12)
    found = generation.generate(prompts, _counting, "once", generation.Batching(rows=4)).collect()
    models = {r.answer.split()[0] for r in found}
    assert len(found) == 300 and len(models) <= 4  # no more than the session has workers
    assert generation.generate(prompts.where("false"), _counting).isEmpty()


def test_wrong_number_of_answers_is_an_error(spark):
    prompts = spark.range(5).select(F.col("id").alias("query_id"), F.lit("w").alias("prompt"))
    found = generation.generate(prompts, lambda: lambda batch: []).collect()
    assert {r.error for r in found} == {"ValueError: 0 answers to 1 prompts"}


def _wave(spark, rows, folder):
    spark.createDataFrame(rows, "path string, content binary, version long").coalesce(1).write.mode("append").parquet(folder)


def _state(store):
    chunks = {(r.path, r.ord, r.text) for r in store.chunks().collect()}
    edges = {(r.src, r.dst, r.kind) for r in store.edges().collect()}
    docs = store.documents().select("path", "version", "body", "title").collect()
    assert len({d.path for d in docs}) == len(docs)
    return set(map(tuple, docs)), chunks, edges


def _pages(rng, paths, version):
    rows = []
    for p in paths:
        links = " ".join(f"[x](/{rng.choice(ALL)})" for _ in range(rng.randrange(3)))
        parent = f"parent: {rng.choice(ALL)}\n" if rng.random() < 0.3 else ""
        rows.append((p, f"---\ntitle: t{version}\n{parent}---\n# {p}\n{links}\n{'word ' * rng.randrange(40)}".encode(), version))
    return rows


ALL = [f"a/p{i}.md" for i in range(30)]


def _full_load(spark, rows, tmp_path, name):
    """The state after one batch of everything."""
    store = ingest.Store(spark, str(tmp_path / name), 10, 2)
    store.write(spark.createDataFrame(rows, "path string, content binary, version long"), 0)
    return _state(store)


def test_increments_give_the_state_of_a_full_load(spark, tmp_path):
    """After every wave the store is as one load of all rows so far: links to later pages, older versions that come late, removed pages and pages that come again."""
    rng, source, done = random.Random(4), str(tmp_path / "in"), []
    store = ingest.Store(spark, str(tmp_path / "store"), 10, 2)
    waves = [_pages(rng, ALL[:12], 1), _pages(rng, ALL[8:20], 3) + [(ALL[0], None, 2)], _pages(rng, ALL[5:10], 2) + _pages(rng, ALL[:2], 4), _pages(rng, ALL[20:], 1) + [(ALL[20], None, 5), (ALL[20], b"again", 6), ("b/empty.md", b"", 1)]]
    for i, wave in enumerate(waves):
        _wave(spark, wave, source)
        done += wave
        ingest.ingest(ingest.file_stream(spark, source, 1), store, str(tmp_path / "checkpoint")).awaitTermination()
        assert _state(store) == _full_load(spark, done, tmp_path, f"full{i}")
        assert store.committed().count() == i + 1
    assert {r.path for r in store.changed(3).collect()} <= {r[0] for r in waves[3]}
    # nothing new: no batch
    ingest.ingest(ingest.file_stream(spark, source, 1), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.committed().count() == len(waves)


def test_a_batch_that_failed_counts_once_after_a_restart(spark, tmp_path):
    class Failing(ingest.Store):
        def _put(self, table, rows, batch):
            super()._put(table, rows, batch)
            if table == "refs" and batch == 1:
                raise RuntimeError("lost")

    rng, source = random.Random(6), str(tmp_path / "in")
    waves = [_pages(rng, ALL[:6], 1), _pages(rng, ALL[3:9], 2)]
    for wave in waves:
        _wave(spark, wave, source)
    broken = Failing(spark, str(tmp_path / "store"), 10, 2)
    with pytest.raises(Exception):
        ingest.ingest(ingest.file_stream(spark, source, 1), broken, str(tmp_path / "checkpoint")).awaitTermination()
    first = _full_load(spark, waves[0], tmp_path, "first")
    assert _state(broken) == first  # what the failed batch wrote is not seen
    whole = ingest.Store(spark, str(tmp_path / "store"), 10, 2)
    ingest.ingest(ingest.file_stream(spark, source, 1), whole, str(tmp_path / "checkpoint")).awaitTermination()
    assert _state(whole) == _full_load(spark, waves[0] + waves[1], tmp_path, "both")
    assert whole.committed().count() == 2


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bundle"))
    docs = spark.range(1000).select(F.format_string("%s/p%04d.md", F.when(F.col("id") % 2 == 0, "a").otherwise("b"), "id").alias("path"), F.when(F.col("id") % 5 == 0, "store").when(F.col("id") % 5 == 1, None).otherwise("item").alias("doc_type"), F.col("id").cast("string").alias("title"), F.lit("x").alias("body"))
    docs = docs.select("*", *[F.lit(None).cast("string").alias(c) for c in ("description", "status", "fm")], F.array("title").alias("tags"))
    chunks = docs.select(F.concat("path", F.lit("-0")).alias("chunk_id"), "path", F.lit("struct").alias("policy"), F.lit(0).alias("ord"), F.col("body").alias("text"))
    vectors = chunks.select("chunk_id", "path", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    edges = docs.select(F.col("path").alias("src"), F.col("path").alias("dst"), F.lit("prose").alias("kind"), F.lit("authored").alias("provenance"))
    bundle_source.write(folder, docs, chunks, edges, {"struct": vectors}, 50)
    return folder, docs.cache()


@pytest.mark.parametrize("where", [
    "true", "doc_type = 'store'", "doc_type is null", "doc_type in ('item', 'none')", "path like 'a/p00%'", "path = 'b/p0501.md'", "path > 'b/p09' and doc_type = 'item'", "path <= 'a/p0010.md'",
    "title = '7' or path = 'a/p0000.md'", "size(tags) = 1 and path >= 'b/p0990.md'", "path = 'nothing'", "doc_type <> 'item'", "lower(path) like 'a/p0%' and path < 'a/p0100.md'",
])
def test_bundle_source_filters(spark, bundle, where):
    folder, docs = bundle
    rows = lambda df: sorted((r.path, r.doc_type, r.title, tuple(r.tags)) for r in df.where(where).collect())
    assert rows(bundle_source.read(spark, folder)) == rows(docs)


def test_bundle_source_opens_the_ranges_that_filters_leave(bundle):
    folder, _ = bundle
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    def groups(*tests):
        reader = bundle_source.BundleSource({"path": folder}).reader(StructType.fromDDL(bundle_source.BundleSource({"path": folder}).schema()))
        assert list(reader.pushFilters(list(tests))) == []
        return sum(len(r.groups) for r in reader.partitions())

    every = groups()
    assert every >= 10
    assert 0 < groups(StringStartsWith(("path",), "a/p000")) < every / 2
    assert 0 < groups(EqualTo(("doc_type",), "store"), EqualTo(("path",), "a/p0500.md")) <= 2
    assert groups(EqualTo(("path",), "zzz")) == 0
    small = bundle_source.BundleReader(f"{folder}/docs", StructType.fromDDL(bundle_source.BundleSource({"path": folder}).schema()), 1)
    assert len(small.partitions()) == every


def test_bundle_layouts_and_vectors(spark, bundle, tmp_path):
    folder, docs = bundle
    assert bundle_source.read(spark, folder, "vectors").where("path like 'a/%'").count() == 500
    edges = bundle_source.read(spark, folder, "edges").limit(3)
    chunk = docs.limit(20).select(F.concat("path", F.lit("-0")).alias("chunk_id"), "path", F.lit("flat").alias("policy"), F.lit(0).alias("ord"), F.col("body").alias("text"))
    pilot, odd, holes = (str(tmp_path / x) for x in ("pilot", "odd", "holes"))
    bundle_source.write(pilot, docs.limit(20), chunk.withColumn("vector", F.array(F.lit(1.0))), edges)
    assert bundle_source.read(spark, pilot, "chunks", layout="pilot").where("vector[0] = 1.0").count() == 20
    bundle_source.write(holes, docs.limit(20), chunk.withColumn("vector", F.when(~F.startswith("path", F.lit("a/p0004")), F.array(F.lit(1.0)))), edges)
    bundle_source.write(odd, docs.limit(20), chunk.withColumn("vector", F.when(F.startswith("path", F.lit("a/p0004")), F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))), edges)
    for broken, said in ((holes, "null vectors"), (odd, "unlike lengths")):
        with pytest.raises(Exception, match=said):
            bundle_source.read(spark, broken, "chunks", layout="pilot").collect()
    with pytest.raises(Exception, match="has no part"):
        bundle_source.read(spark, pilot, "vectors", layout="pilot").collect()
    bundle_source.write(none := str(tmp_path / "none"), docs.where("false"), chunk.where("false"), edges.where("false"), {})
    assert bundle_source.read(spark, none).isEmpty()


def _tree_files(spark, names):
    return spark.createDataFrame([(p, c) for p, c in names.items()], "path string, content string")


def test_trees_differ_where_files_do(spark):
    rng = random.Random(9)
    base = {f"d/{i}": f"text {i}" for i in range(500)}
    other = dict(base)
    for p in rng.sample(sorted(base), 6):
        other[p] += "!"
    gone, new = sorted(base)[7], "d/new"
    del other[gone]
    other[new] = ""
    base["d/null"], other["d/null"] = None, ""
    want = {(p, "mismatch") for p in base if p in other and base[p] != other[p]} | {(gone, "extra"), (new, "missing")}
    for depth in (1, 3):
        one, two = (digest_tree.build(_tree_files(spark, x).repartition(n), depth=depth) for x, n in ((base, 2), (other, 5)))
        assert {(r.path, r.problem) for r in digest_tree.compare(one, two).collect()} == want
        assert one.nodes(0).first().n == len(base) and one.root() != two.root()
    leaves = digest_tree.differing_leaves(one, two).count()
    assert leaves <= len(want) and leaves < one.nodes(3).count() / 10


def test_trees_of_equal_and_empty_collections(spark):
    names = {f"d/{i}": "t" for i in range(40)}
    one, two, none = (digest_tree.build(_tree_files(spark, x), depth=2) for x in (names, dict(reversed(names.items())), {}))
    assert one.root() == two.root() and digest_tree.compare(one, two).isEmpty()
    assert none.root() is None and digest_tree.compare(none, none).isEmpty()
    assert digest_tree.compare(none, one).where("problem = 'missing'").count() == 40
    with pytest.raises(ValueError):
        digest_tree.compare(one, digest_tree.build(_tree_files(spark, names), depth=1))


def test_a_bundle_has_a_file_for_many_row_groups(bundle):
    import glob

    import pyarrow.parquet as pq

    files = glob.glob(f"{bundle[0]}/docs/*.parquet")
    groups = [pq.read_metadata(f).row_group(i).num_rows for f in files for i in range(pq.read_metadata(f).num_row_groups)]
    assert sum(groups) == 1000 and max(groups) <= 50 and len(files) < len(groups)


def test_front_matter_is_parsed_once_for_documents_and_links(spark):
    from docloom.plans import markup
    from docloom.sources import markdown

    plan = markup.ingest_docs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "ArrowEvalPython" not in plan
    for text in ("a: 1\nb: [x, 'y']\n", "t: 2004-01-02\nn: ~\ny: yes\nz: 1e3\n", "", "plain", "q: 'it''s'\nu: \"\\u00e9 é\"\n"):
        import json

        import yaml

        assert markdown._front(text) == json.dumps(yaml.safe_load(text) or {}, default=str)
