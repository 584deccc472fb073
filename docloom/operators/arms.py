"""Retrieval configurations side by side: all arms over all questions in one plan, and comparing lanes for a few questions."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_stem
from . import chunking, graph, metadata, ranking
from .lineage import kept


def run_arms(
    questions: DataFrame, docs: DataFrame, fields: DataFrame, edges: DataFrame, filters: DataFrame | None = None, wanted: DataFrame | None = None,
    dense: dict[str, DataFrame] | None = None, units: DataFrame | None = None, ranked_units: DataFrame | None = None, texts: DataFrame | None = None,
    extracted: DataFrame | None = None, model_filters: DataFrame | None = None, rrf_k: int = 30, pilot_k: int = 60, k: int = ranking.DOCS,
) -> DataFrame:
    """arm, query_id, path and rank of every arm whose inputs are given.

    questions (query_id, text); docs, fields and edges as metadata.py and graph.py take them. Other inputs:

    filters, model_filters: conditions parsed by rules (R6f) and by a model (R6l); wanted (query_id,
    doc_type): the asked types (R5p); extracted: links that a model found (R3x); texts (unit_id,
    path, text): passages for the lexical arms (C_bm25, C_flat_hybrid); dense: rankings of documents
    (query_id, path, score, rank) by vectors of flat passages (R0), of sections (R1), of sections in context (R1c) or
    under their headings (R1h); units (unit_id, path) and ranked_units (query_id, unit_id, path, rank): sections and
    their ranking, for the budgeted walk (R3a). What fuses or expands other arms needs those.
    """
    named = lambda ranked: kept(ranked.withColumnRenamed("unit_id", "path"), "arm")
    # rankings that others fuse or expand are computed once
    arms = {"R2s": named(ranking.bm25(metadata.pseudo_docs(docs, fields), questions, k, tokens=normalize_stem)), "R2": named(ranking.bm25(metadata.pseudo_docs_v1(docs, fields), questions, k))}
    r2s = arms["R2s"]
    arms |= {name: kept(ranked, "arm") for name, ranked in (dense or {}).items()}
    matches = kept(graph.title_match(questions, docs), "matches")

    def fused(constant: int, *names: str) -> DataFrame:
        rows = [arms[n].select("query_id", F.col("path").alias("doc"), "rank", F.lit(n).alias("ranking")) for n in names]
        return ranking.rrf(reduce(DataFrame.unionByName, rows), constant, k).withColumnRenamed("doc", "path")

    arms["R3s"] = graph.expand_weighted(r2s, edges, k=k)
    if extracted is not None:
        arms["R3x"] = graph.expand_weighted(r2s, extracted, k=k)
    sections = next((n for n in ("R1c", "R1") if n in arms), None)
    if sections:
        arms["R3d"] = graph.expand_docs(arms[sections], edges, k=k)
    if units is not None and ranked_units is not None:
        walked = graph.budgeted(ranked_units, units, edges).join(units, "unit_id")
        arms["R3a"] = kept(ranking.collapse(walked, "path", k), "arm")
    if {"R1", "R3a"} <= set(arms):
        arms["R4"] = fused(pilot_k, "R1", "R2", "R3a")
    if "R1c" in arms:
        arms["R4c"] = fused(pilot_k, "R1c", "R2s", "R3d")
    if texts is not None:
        best = ranking.bm25(texts.select("unit_id", "text"), questions, k).join(texts.select(F.col("unit_id").cast("string").alias("unit_id"), "path"), "unit_id")
        arms["C_bm25"] = kept(ranking.collapse(best, "path", k), "arm")
        if "R0" in arms:
            arms["C_flat_hybrid"] = fused(pilot_k, "R0", "C_bm25")
    if wanted is not None:
        arms["R5p"] = metadata.tiered(graph.parent_aware(matches, wanted, docs, edges), r2s, k)
    for name, conditions in (("R6f", filters), ("R6l", model_filters)):
        if conditions is not None:
            arms[name] = metadata.tiered(metadata.apply_filters(fields, conditions), r2s, k)
    if "R0" in arms:
        arms["R7f"] = kept(fused(rrf_k, "R2s", "R0"), "arm")
        similar = arms.get("R1", arms["R0"]).select("query_id", "path", "score")
        arms["R7h"] = graph.two_step(matches, edges, similar, arms["R7f"].select("query_id", "path", "rank"), k=k)
    rows = [ranked.select(F.lit(name).alias("arm"), "query_id", "path", F.col("rank").cast("long").alias("rank")) for name, ranked in arms.items()]
    return reduce(DataFrame.unionByName, rows)


def compare(spark: SparkSession, question: str, lanes: dict[str, Callable[[DataFrame], DataFrame]], sections: DataFrame, generate: Callable[[str, str], str] | None = None, k: int = 5, budget: int = 2048) -> DataFrame:
    """One row for each lane: its sources, packed documentation, tokens, answer, seconds, and the error that ended it, if one did.

    A lane maps questions (query_id, text) to a ranking (query_id, doc, rank); sections have doc,
    ord and text. One lane's error leaves the others as they are. What reaches the driver is the
    packed context of one question, bounded by the budget.
    """
    asked = spark.createDataFrame([("question", question)], "query_id string, text string")
    rows = []
    for name, lane in lanes.items():
        start = time.perf_counter()
        try:
            ordered = chunking.evidence_order(lane(asked).where(F.col("rank") <= k), sections)
            packed = chunking.pack_context(ordered.withColumn("path", F.col("doc").cast("string")), budget)
            row = chunking.numbered_documentation(packed).join(packed.groupBy("query_id").agg(F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("path")).alias("sources")), "query_id").first()
            documentation = row.documentation if row else ""
            answer = generate(question, documentation) if generate else None
            rows.append((name, row.sources if row else [], documentation, row.tokens if row else 0, answer, time.perf_counter() - start, None))
        except Exception as error:  # a lane's failure is its result
            rows.append((name, [], None, None, None, time.perf_counter() - start, f"{type(error).__name__}: {str(error)[:200]}"))
    return spark.createDataFrame(rows, "lane string, sources array<string>, documentation string, tokens long, answer string, seconds double, error string")
