"""The document store: upserts, scoped refreshes, checks of vectors before they are loaded, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Stored and incoming rows by key: incoming ones replace stored ones; of several, the last in the given order stays."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *order))
    return both.withColumn("_place", place).where("_place = 1").drop("_new", "_place")


def refresh_edges(stored: DataFrame, incoming: DataFrame, known: DataFrame, provenance: str) -> DataFrame:
    """Links (src, dst, kind, provenance) after those of the incoming sources and this provenance were replaced; links with an unknown end are left out."""
    scope = incoming.select("src").distinct().withColumn("provenance", F.lit(provenance))
    kept = stored.join(scope, ["src", "provenance"], "left_anti").select("src", "dst", "kind", "provenance")
    ends = lambda c: known.select(F.col("path").alias(c)).distinct()
    new = incoming.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    return kept.unionByName(new.select("src", "dst", "kind").distinct().withColumn("provenance", F.lit(provenance)))


def vector_checks(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each of five checks of vectors (chunk_id, doc_id, vector) against chunks (chunk_id, doc_id): check and n_bad. A missing column fails its check and those that need it."""
    need = ["chunk_id", "doc_id", "vector"]
    missing = [c for c in need if c not in vectors.columns]
    spark = vectors.sparkSession
    head = spark.createDataFrame([("missing column", len(missing))], "check string, n_bad bigint")
    if missing:
        return head
    count = lambda name, df: df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    twice = vectors.groupBy("chunk_id").count().where("count > 1")
    known = chunks.select("chunk_id", F.col("doc_id").alias("_doc"))
    out = head.unionByName(count("duplicate id", twice)).unionByName(count("null vector", vectors.where("vector is null")))
    out = out.unionByName(count("unknown id", vectors.join(known, "chunk_id", "left_anti")))
    return out.unionByName(count("document mismatch", vectors.join(known, "chunk_id").where(~F.col("doc_id").eqNullSafe(F.col("_doc")))))


def pair_difference(one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    """Rows of one table only, with the side."""
    marked = one.select(*keys).distinct().withColumn("_a", F.lit(1)).join(two.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full")
    return marked.where("_a is null or _b is null").select(*keys, F.when(F.col("_b").isNull(), "only stored").otherwise("only expected").alias("side"))


def fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over the files' (path, content) by path, for collections that fit one row."""
    entry = F.concat(F.col("path").cast("binary"), F.lit(b"\0"), F.col("content"), F.lit(b"\0"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), F.lit(b""), lambda s, x: F.concat(s, x["e"]))
    return files.agg(F.sha2(joined, 256).alias("sha256"), F.count("*").alias("n_files"))


def fingerprint_levels(files: DataFrame, digits: int = 3) -> DataFrame:
    """As fingerprint, for collections of any size: of each file's path and content digest, in 16**digits groups by the path's hash, then of the groups' digests.

    No content leaves its task, and no row holds more than a group's lines or the groups' digests.
    """
    line = F.concat(F.col("path"), F.lit(" "), F.sha2("content", 256))
    rows = files.select(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, digits).alias("part"), line.alias("line"))
    parts = rows.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("h"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: F.concat(x["part"], F.lit(" "), x["h"]))
    return parts.agg(F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("sha256"), F.sum("n").alias("n_files"))


def replace_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks (doc_id, policy, ord, text) after those of the incoming rows' documents and policies were replaced by the incoming rows.

    A pair of document and policy that the incoming rows do not have stays as it is.
    """
    scope = incoming.select("doc_id", "policy").distinct()
    return stored.join(scope, ["doc_id", "policy"], "left_anti").select(stored.columns).unionByName(incoming.select(stored.columns))


def shared_shingles(left: DataFrame, right: DataFrame, length: int = 8) -> DataFrame:
    """id pairs (left_id, right_id) of the same doc whose texts share a run of `length` characters, by an equi-join of shingles; shorter texts have none."""
    grams = lambda df, c: df.where(F.length("text") >= length).select("doc", F.col("id").alias(c), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - length + 1), lambda i: F.substring("text", i, length)))).alias("gram"))
    # Spark takes shingles to be as large as their texts, so it would send a side through the driver: merged instead
    return grams(left, "left_id").hint("merge").join(grams(right, "right_id"), ["doc", "gram"]).select("doc", "left_id", "right_id").distinct()


def basename_conflicts(tree: DataFrame, others: DataFrame, root: str) -> DataFrame:
    """basename, conflict and n: names that paths of the tree share ("twice"), and that paths outside its root have too ("outside")."""
    named = lambda df: df.groupBy(F.substring_index("path", "/", -1).alias("basename")).agg(F.count("*").alias("n"))
    own, outside = named(tree), named(others.where(~F.startswith("path", F.lit(root.rstrip("/") + "/"))))
    twice = own.where("n > 1").select("basename", F.lit("twice").alias("conflict"), "n")
    return twice.unionByName(outside.join(own.select("basename"), "basename").select("basename", F.lit("outside").alias("conflict"), "n"))


def parent_leaks(docs: DataFrame, parent_field: dict[str, str], names: DataFrame, mark: str = "Part of [its parent page](") -> DataFrame:
    """path and leak ("field", "tag", "parent", "link"): documents (path, doc_type, tags, fm, body) of types that must not say their parent, but do.

    parent_field names the field of each such type; names (doc_type, name) has what its tags may not hold.
    """
    field = F.try_element_at(F.create_map(*(F.lit(x) for pair in parent_field.items() for x in pair)), "doc_type")
    rows = docs.withColumn("_field", field).where("_field is not null").withColumn("_fm", F.from_json("fm", "map<string, string>"))
    held = lambda key: F.coalesce(F.map_contains_key("_fm", key), F.lit(False))
    found = F.array(F.when(held(F.col("_field")), "field"), F.when(held(F.lit("parent")), "parent"), F.when(F.contains("body", F.lit(mark)), "link"))
    own = rows.select("path", F.explode(F.array_compact(found)).alias("leak"))
    tags = rows.select("path", "doc_type", F.explode("tags").alias("name")).join(names.select("doc_type", "name").distinct(), ["doc_type", "name"])
    return own.unionByName(tags.select("path", F.lit("tag").alias("leak")).distinct())
