"""Metadata of documents: pseudo-documents, field kinds, categorical values, and filters.

A document's fields are rows (path, doc_type, field, kind, vals, num): vals holds the value, or a
list's values, as strings; num holds numbers, and booleans as 1 and 0. Filters are rows
(query_id, doc_type, n, field, op, s, x): s holds string operands, x numeric ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_stem, value_text
from .ranking import DOCS, ordered_union

#: Fields that a schema description leaves out (fixed values).
SCHEMA_SKIP = "tags parent supersedes store_id dept_id region_id departments city state manager store fiscal_year applies_to".split()


def pseudo_docs(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """unit_id and text: title, description, tags, type, status, then each field by name with its value, stemmed."""
    values = F.transform(F.col("vals"), value_text)
    listed = fields.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("field", F.array_join(values, " ").alias("value")))).alias("_f"))
    rest = F.transform(F.coalesce("_f", F.array().cast("array<struct<field: string, value: string>>")), lambda f: F.concat_ws(" ", f["field"], f["value"]))
    label = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name + " "), F.col(c)))
    whole = F.concat_ws(" ", F.col("title"), F.col("description"), F.array_join("tags", " "), label("type", "doc_type"), label("status", "status"), F.array_join(rest, " "))
    return docs.join(listed, "path", "left").select(F.col("path").alias("unit_id"), F.array_join(normalize_stem(whole), " ").alias("text"))


def pseudo_docs_v1(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """unit_id and text: one line "key: value" for title, type and each field by name; lists joined by commas, booleans capitalised."""
    plain = F.transform(F.col("vals"), lambda v: F.when(v.isin("true", "false"), F.initcap(v)).otherwise(v))
    listed = fields.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("field", F.array_join(plain, ", ").alias("value")))).alias("_f"))
    rest = F.transform(F.coalesce("_f", F.array().cast("array<struct<field: string, value: string>>")), lambda f: F.concat(f["field"], F.lit(": "), f["value"]))
    head = F.array(F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("type: "), F.col("doc_type")))
    return docs.join(listed, "path", "left").select(F.col("path").alias("unit_id"), F.array_join(F.concat(head, rest), "\n").alias("text"))


def field_types(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_type, field and kind of the fields on at least half of a type's documents; the kind is that of the last path."""
    sizes = docs.groupBy("doc_type").agg(F.count("*").alias("_n"))
    found = fields.groupBy("doc_type", "field").agg(F.count_distinct("path").alias("_k"), F.max_by("kind", "path").alias("kind"))
    return found.join(sizes, "doc_type").where(2 * F.col("_k") >= F.col("_n")).select("doc_type", "field", "kind")


def categorical_values(fields: DataFrame, limit_to: list[str]) -> DataFrame:
    """doc_type, field and the sorted distinct values of categorical fields."""
    each = fields.where(F.col("field").isin(limit_to)).select("doc_type", "field", F.explode("vals").alias("value"))
    return each.groupBy("doc_type", "field").agg(F.array_sort(F.collect_set("value")).alias("vals"))


def filter_schema(types: DataFrame, values: DataFrame) -> DataFrame:
    """doc_type, field and what a prompt says of the field: the first ten values, or the kind."""
    shown = F.concat(F.array_join(F.slice("vals", 1, 10), ", "), F.when(F.size("vals") > 10, ", ...").otherwise(""))
    kinds = F.create_map(*(F.lit(x) for x in ("int", "integer", "bool", "true/false", "date", "YYYY-MM-DD")))
    told = F.when(F.col("vals").isNotNull(), F.concat(F.when(F.col("kind") == "list", "list of: ").otherwise("one of: "), shown)).otherwise(F.try_element_at(kinds, F.col("kind")))
    return types.where(~F.col("field").isin(SCHEMA_SKIP)).join(values, ["doc_type", "field"], "left").select("doc_type", "field", told.alias("description")).where("description is not null")


def _month(date: Column) -> Column:
    return F.substring(date, 6, 2).try_cast("int")


def condition() -> Column:
    """Whether a field row meets a filter row's condition; a comparison of different kinds of values does not."""
    vals, s, num, x = F.col("vals"), F.col("s"), F.col("num"), F.col("x")
    one, low = F.get(vals, F.lit(0)), F.get(x, F.lit(0))
    both = num.isNotNull() & (F.size(x) > 0)
    word = num.isNull() & (F.size(s) > 0) & (F.col("kind") != "list")
    first = F.get(s, F.lit(0))
    equal = F.when(both, num == low).when(word, one == first).otherwise(False)
    order = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    out = F.when(F.col("op") == "in", F.arrays_overlap(vals, s))
    out = out.when(F.col("op") == "not_in", ~F.arrays_overlap(vals, s))
    out = out.when(F.col("op") == "only", F.array_sort(F.array_distinct(vals)) == F.array_sort(F.array_distinct(s)))
    out = out.when(F.col("op") == "==", equal).when(F.col("op") == "!=", ~equal)
    for op, test in order.items():
        out = out.when(F.col("op") == op, F.when(both, test(num, low)).when(word, test(one, first)).otherwise(False))
    out = out.when(F.col("op") == "between", both & num.between(low, F.get(x, F.lit(1))))
    out = out.when(F.col("op").isin("start_month", "end_month"), _month(one) == low)
    # month_overlap is met by a start and an end: see apply_filters
    out = out.when(F.col("op") == "month_overlap", F.when(F.col("field") == "end", _month(one) >= low).otherwise(_month(one) <= low))
    return F.coalesce(out, F.lit(False))


def apply_filters(fields: DataFrame, filters: DataFrame) -> DataFrame:
    """query_id and path of the documents of each query's type that meet all its filters; a missing field meets none.

    month_overlap has a part for the start and one for the end, so no rows of a document are joined. A type has few fields, so
    field rows meet filters by a hash of their path too: no field's rows are one task's.
    """
    op = F.col("op")
    part = lambda field, name: F.struct(F.lit(field).alias("field") if isinstance(field, str) else field.alias("field"), F.lit(name).alias("part"))
    about = F.when(op == "month_overlap", F.array(part("start", ""), part("end", "end"))).when(op == "start_month", F.array(part("start", ""))).when(op == "end_month", F.array(part("end", ""))).otherwise(F.array(part(F.col("field"), "")))
    wanted = filters.select("query_id", "doc_type", "n", "op", "s", "x", F.explode(about).alias("_a")).select("query_id", "doc_type", "n", "op", "s", "x", "_a.field", "_a.part")
    counts = wanted.groupBy("query_id").agg(F.count_distinct("n", "part").alias("_all"))
    # as many rows as types have fields: those that no filter is about go before anything else
    held = fields.join(F.broadcast(wanted.select("doc_type", "field").distinct()), ["doc_type", "field"], "left_semi")
    ways = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.withColumn("_way", F.pmod(F.xxhash64("path"), F.lit(ways)).cast("int"))
    met = held.join(wanted.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), ["doc_type", "field", "_way"]).where(condition())
    # few rows are of one query and path, so they are grouped after the exchange, not in the maps before it
    found = met.select("query_id", "path", "n", "part").repartition(ways, "query_id", "path").groupBy("query_id", "path").agg(F.count_distinct("n", "part").alias("_met"))
    return found.join(counts, "query_id").where(F.col("_met") == F.col("_all")).select("query_id", "path")


def tiered(hits: DataFrame, ranked: DataFrame, k: int = DOCS) -> DataFrame:
    """Hits (query_id, path) by their lexical score (none: 0), then the lexical ranking (query_id, path, score, rank); distinct."""
    scored = hits.join(ranked.select("query_id", "path", "score"), ["query_id", "path"], "left").fillna({"score": 0.0})
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path"))
    first = scored.withColumn("pos", place).where(F.col("pos") <= k).select("query_id", F.lit(0).alias("tier"), "pos", "path")
    rest = ranked.select("query_id", F.lit(1).alias("tier"), F.col("rank").cast("int").alias("pos"), "path")
    return ordered_union(first.unionByName(rest), "path", k)


def metadata_oracle(fields: DataFrame, field: str, values: list[str], op: str) -> DataFrame:
    """Paths whose field holds exactly the values, in any order (exact_set), or all of them (contains)."""
    wanted = F.array(*[F.lit(v) for v in values])
    test = F.array_sort(F.array_distinct("vals")) == F.array_sort(F.array_distinct(wanted)) if op == "exact_set" else F.size(F.array_except(wanted, "vals")) == 0
    return fields.where((F.col("field") == field) & test).select("path")


def under(docs: DataFrame, prefix: str, include_descendants: bool = False) -> DataFrame:
    """Paths under a directory: its own documents, or all below it."""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
    inside = F.col("path").startswith(prefix) & (F.lit(include_descendants) | ~F.contains(rest, F.lit("/")))
    return docs.where(inside).select("path")
