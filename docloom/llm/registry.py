"""The corpus operators as queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(_table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import NearRule
    from .packing import assign

    return assign(_table(spark, sf_dir, "documents"), near=NearRule())


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import dedup

    # 50 words of these languages are 240 bytes at least, but for one passage in a hundred
    found = dedup(_table(spark, sf_dir, "documents"), "doc_id", passage=240)
    removed = F.expr("aggregate(removed, 0L, (s, x) -> s + x.end - x.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find, verdict

    found = verdict(find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    found = dedup(_table(spark, sf_dir, "documents"), "doc_id")
    removed = F.expr("aggregate(removed, 0L, (s, x) -> s + x.end - x.start)")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"), "doc_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    found = score(docs, docs.where(~held_out), "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import NearRule, components

    found = components(_table(spark, sf_dir, "documents"), NearRule(words=2))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The vocabulary that op10 counts with; read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count, load_vocabulary

    return count(_table(spark, sf_dir, "documents"), "doc_id", vocabulary=load_vocabulary(VOCABULARY))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_table(spark, sf_dir, "documents"), "doc_id")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages"), "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.QUALITY, "op4_decontamination": sql.DECONTAMINATION, "op3_suffix_array_dedup": sql.SUFFIXES, "op5_substring_dedup": sql.SUBSTRING, "op8_warc": sql.WARC, "op9_near_duplicates": sql.NEAR, "op11_filter_audit": sql.AUDIT, "op13_url_filters": sql.URLS}


__all__ = ["queries", "oracle_sql"]
