"""Bundles: documents with their chunks, links and vectors, checked when loaded; notes; totals of a model's graph answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.questions import first_json_object, model_links
from ..functions.text import whitespace_tokens


def load(docs: DataFrame, chunks: DataFrame, edges: DataFrame, vectors: DataFrame, policy: str = "struct") -> dict[str, DataFrame]:
    """docs, chunks (those of known documents, with their vector, null for other policies) and authored edges between known documents.

    docs have path; chunks chunk_id, path, policy, ord and text; edges src, dst, kind and provenance;
    vectors chunk_id, path and vector. No documents, a chunk of the policy without a vector, and a
    vector without its chunk are errors: the message has their number.
    """
    if docs.isEmpty():
        raise ValueError("the bundle has no documents")
    known = docs.select("path").distinct()
    kept = chunks.join(known, "path", "left_semi")
    wanted = kept.where(F.col("policy") == policy).select("chunk_id", "path", F.lit(1).alias("_chunk"))
    given = vectors.select("chunk_id", "path", "vector", F.lit(1).alias("_vector"))
    bad = wanted.join(given, ["chunk_id", "path"], "full").agg(
        F.count_if(F.col("_vector").isNull() | (F.col("_chunk").isNotNull() & F.col("vector").isNull())).alias("missing"), F.count_if(F.col("_chunk").isNull()).alias("stale")
    ).first()
    if bad.missing or bad.stale:
        raise ValueError(f"{bad.missing} chunks lack vectors, {bad.stale} vectors have no chunk: embed the bundle again")
    of_policy = given.select("chunk_id", "path", "vector", F.lit(policy).alias("policy"))
    ends = lambda c: known.select(F.col("path").alias(c))
    authored = edges.where("provenance = 'authored'").join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    return {"docs": docs, "chunks": kept.join(of_policy, ["chunk_id", "path", "policy"], "left"), "edges": authored.select("src", "dst", "kind")}


def with_notes(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """pages (path, content) with a Notes section after the content of those whose file stem has notes (stem, text)."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    own = notes.select(F.col("stem").alias("_stem"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("_notes"))
    joined = pages.withColumn("_stem", stem).join(own, "_stem", "left")
    added = F.when(F.col("_notes").isNotNull(), F.concat(F.lit("\n## Notes\n\n"), "_notes", F.lit("\n"))).otherwise("")
    return joined.withColumn("content", F.concat("content", added)).select(pages.columns)


def extraction_totals(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """One row of totals over answers (path, prompt, raw): docs, edges to known titles (title, target), answers that are whole JSON, unknown titles, and whitespace tokens."""
    tokens = lambda c: F.coalesce(F.size(whitespace_tokens(F.col(c))), F.lit(0))
    own = answers.agg(
        F.count("*").alias("docs"), F.count_if(first_json_object(F.col("raw")).isNotNull()).alias("parse_ok"),
        F.coalesce(F.sum(tokens("prompt")), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(tokens("raw")), F.lit(0)).alias("completion_tokens"),
    )
    each = answers.select("path", F.explode(model_links(F.col("raw"))).alias("x")).select("path", F.lower("x.title").alias("_key"))
    found = each.join(titles.select(F.lower("title").alias("_key"), "target"), "_key", "left").where("target is null or target <> path")
    counted = found.agg(F.count("target").alias("edges"), F.count_if(F.col("target").isNull()).alias("unknown_titles"))
    return own.crossJoin(counted).select("docs", "edges", "parse_ok", "unknown_titles", "prompt_tokens", "completion_tokens")  # two single rows
