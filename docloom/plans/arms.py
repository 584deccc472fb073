"""The retrieval configurations side by side, over the wiki of the star schema.

Vectors stand for passages: a vector is the flat passage of the part page of its number; as sections, even
ones belong to the part of half their number, odd ones to such a supplier. Every fiftieth is a question's.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..operators import metadata, ranking
from ..operators.arms import run_arms
from . import wiki
from .base import bm25_sql, ident_sql, table

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pages(spark, sf_dir) -> DataFrame:
    """The wiki's pages with the numbers that vectors have: number and path of parts and suppliers."""
    docs = wiki.wiki_docs(spark, sf_dir)
    part = docs.where("doc_type = 'part'").select("doc_type", F.regexp_extract("path", r"^part/(\d+)\.md$", 1).cast("long").alias("number"), "path")
    supplier = docs.where("doc_type = 'supplier'").select("doc_type", F.regexp_extract("path", r"supplier-(\d+)\.md$", 1).cast("long").alias("number"), "path")
    return part.unionByName(supplier)


def _vectors(spark, sf_dir, policy: str) -> DataFrame:
    """unit_id, path and embedding of flat passages or of sections."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    if policy == "flat":
        rows = rows.select("*", F.lit("part").alias("doc_type"), F.col("unit_id").alias("number"))
    else:
        rows = rows.select("*", F.when(F.col("unit_id") % 2 == 0, "part").otherwise("supplier").alias("doc_type"), F.floor(F.col("unit_id") / 2).alias("number"))
    return rows.join(_pages(spark, sf_dir), ["doc_type", "number"]).select("unit_id", "path", "embedding")


def _asked_vectors(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*(50 * (i + 1) for i in range(len(wiki.QUESTIONS)))))
    return rows.select(F.concat(F.lit("w"), F.floor(F.col("vec_id") / 50).cast("string")).alias("query_id"), "embedding")


def _r0(spark, sf_dir, policy: str = "flat") -> DataFrame:
    return ranking.dense_docs(_vectors(spark, sf_dir, policy), _asked_vectors(spark, sf_dir), "path", "unit_id")


_R0 = """qv as (select 'w' || (vec_id // 50) as query_id, embedding::double[] as qe from embeddings where vec_id % 50 = 0 and vec_id between 50 and 300),
pg as (select 'part' as kind, p_partkey as number, 'part/' || p_partkey || '.md' as path from part union all select 'supplier', s_suppkey, 'region/' || r_name || '/' || n_name || '/supplier-' || s_suppkey || '.md' from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
d0 as (select query_id, vec_id as unit_id, path, round(list_inner_product(qe, embedding::double[]), 6) + 0.0::double as score from qv, embeddings join pg on kind = 'part' and number = vec_id),
r0 as (select * from (select query_id, path, score, row_number() over (partition by query_id order by score desc, unit_id) as rank from d0) where rank <= 50)"""


@query
def arm_r7f(spark, sf_dir):
    """Fusion of the metadata ranking and the dense one."""
    rows = wiki.arm_r2s_all(spark, sf_dir).select("query_id", F.col("path").alias("doc"), "rank", F.lit("R2s").alias("ranking"))
    return ranking.rrf(rows.unionByName(_r0(spark, sf_dir).select("query_id", F.col("path").alias("doc"), "rank", F.lit("R0").alias("ranking"))), 30, 50)


def _fused_sql(name: str, constant: int, *rankings: str) -> str:
    rows = " union all ".join(f"select query_id, path, rank from {r}" for r in rankings)
    return f"""{name}_s as (select query_id, path, round(sum(1.0::double / ({constant} + rank)), 9) as score from ({rows}) group by all),
{name} as (select * from (select query_id, path, score, row_number() over (partition by query_id order by score desc, path) as rank from {name}_s) where rank <= 50)"""


SQL["arm_r7f"] = f"with {wiki.r2s_sql(50)}, {_R0}, {_fused_sql('r7f', 30, 'r2s', 'r0')} select query_id, path as doc, score, rank from r7f"


def _model_answers(spark) -> DataFrame:
    """What a model might answer for the wiki's questions: their conditions as JSON, with words around it."""
    rows = []
    for name, own in wiki.FILTERS.items():
        filters = [{"field": f, "op": op, "value": s if op in ("in", "not_in", "only") else [int(v) for v in x] if op == "between" else s[0] if s else x[0] == 1 if f == "in_credit" else f"{x[0]:,.0f}"} for _, f, op, s, x in own]
        rows.append((name, "The filters are " + json.dumps({"type": own[0][0], "filters": [{"field": "colour", "op": "==", "value": 1}, *filters]}) + "."))
    return spark.createDataFrame(rows, "query_id string, raw string")


def _model_filters(spark, sf_dir) -> DataFrame:
    return Q.model_filters(_model_answers(spark), wiki.field_types(spark, sf_dir))


@query
def arm_r6l(spark, sf_dir):
    """The filters of a model's answers, validated, applied and ranked."""
    return metadata.tiered(metadata.apply_filters(wiki.wiki_fields(spark, sf_dir), _model_filters(spark, sf_dir)), wiki.arm_r2s_all(spark, sf_dir))


SQL["arm_r6l"] = wiki.SQL["filter_rank"]


@query
def arm_matrix(spark, sf_dir):
    """All arms over all questions in one plan."""
    docs, fields, edges = wiki.wiki_docs(spark, sf_dir), wiki.wiki_fields(spark, sf_dir), wiki.wiki_edges(spark, sf_dir)
    told = docs.where("doc_type in ('supplier', 'part')")
    sections = _vectors(spark, sf_dir, "struct")
    ranked_units = ranking.dense_topk(sections, _asked_vectors(spark, sf_dir), 10).join(sections.select("unit_id", "path"), "unit_id")
    wanted = wiki.questions(spark).select("query_id", F.lit("nation").alias("doc_type"))
    found = run_arms(
        wiki.questions(spark), docs, fields.where("doc_type in ('supplier', 'part')"), edges, wiki.filters(spark), wanted,
        {"R0": _r0(spark, sf_dir), "R1": _r0(spark, sf_dir, "struct")}, sections.select("unit_id", "path"), ranked_units,
        told.select(F.col("path").alias("unit_id"), "path", F.concat_ws(" ", "title", "description").alias("text")),
        edges.where("kind = 'child'"), _model_filters(spark, sf_dir),
    )
    return found


_TIERS = "select query_id, path, rank from (select query_id, path, row_number() over (partition by query_id order by place) as rank from (select query_id, path, min(place) as place from ({0}) group by all)) where rank <= {1}"


def _expanded_sql(name: str, near: str) -> str:
    return f"""{name}_b as (select query_id, path, rank, score / max(score) over (partition by query_id) as s from r2s),
{name}_w as (select src, dst, max(case kind when 'child' then 1.0::double else 0.6::double end) as w from {near} group by all),
{name}_l as (select query_id, dst as path, max(0.25::double * w * s) as loan from {name}_b join {name}_w on src = path where rank <= 5 group by query_id, dst),
{name}_m as (select query_id, path, case when rank <= 5 then rank else 1073741824 end as seed, round(coalesce(s, 0) + coalesce(loan, 0), 9) as score from {name}_b full join {name}_l using (query_id, path)),
{name} as (select query_id, path, rank from (select *, row_number() over (partition by query_id order by score desc, seed, path) as rank from {name}_m) where rank <= 50)"""


_ARMS = ("R2s", "R2", "R0", "R1", "R3s", "R3x", "R3d", "R3a", "R4", "C_bm25", "C_flat_hybrid", "R5p", "R6f", "R6l", "R7f", "R7h")
_V1 = "select unit_id, text from v1"
_BODY = "select path as unit_id, concat_ws(' ', title, description) as text from docs where doc_type in ('supplier', 'part')"
_EVERY = wiki.r2s_sql(50).replace(" where doc_type in ('supplier', 'part')", "")  # pseudo-documents of all pages
_EVERY_V1 = wiki.SQL["meta_pseudo_docs_v1"].replace("from docs d join f using (path) where doc_type in ('supplier', 'part')", "from docs d left join f using (path)").replace("|| doc_type || chr(10) || s as text", "|| doc_type || coalesce(chr(10) || s, chr(10)) as text")
_MATRIX = f"""{_EVERY}, {wiki.EDGES}, {wiki.TITLES}, {_R0},
v1 as ({_EVERY_V1}), {bm25_sql(_V1, wiki.ASKED, ident_sql, 50, '_v')}, r2 as (select query_id, unit_id as path, rank from ranked_v),
{bm25_sql(_BODY, wiki.ASKED, ident_sql, 50, '_c')}, c_bm25 as (select query_id, unit_id as path, rank from ranked_c),
su as (select vec_id as unit_id, embedding, path from embeddings join pg on number = vec_id // 2 and kind = case when vec_id % 2 = 0 then 'part' else 'supplier' end),
d1 as (select query_id, unit_id, path, round(list_inner_product(qe, embedding::double[]), 6) + 0.0::double as score from qv, su),
k1 as (select *, row_number() over (partition by query_id order by score desc, unit_id) as r from d1),
r1 as (select * from (select query_id, path, max(score) as score, row_number() over (partition by query_id order by min(r)) as rank from k1 group by query_id, path) where rank <= 50),
{_expanded_sql('r3s', 'near')},
xnear as (select * from near where kind = 'child'), {_expanded_sql('r3x', 'xnear')},
nd as (select r.query_id, dst as path, row_number() over (partition by r.query_id order by r.rank, dst) as pos from r1 r join (select distinct src, dst from near) e on e.src = r.path where r.rank <= 5),
r3d as ({_TIERS.format("select query_id, path, case when rank <= 5 then rank else 2000000 + rank end as place from r1 union all select query_id, path, 1000000 + pos from nd", 50)}),
s10 as (select query_id, unit_id, path, r as rank from k1 where r <= 10),
wk as (select s.query_id, n.dst as path, min(s.rank) as seed from s10 s join near n on n.src = s.path where (s.query_id, n.dst) not in (select query_id, path from s10) group by all),
nu as (select w.query_id, u.unit_id, row_number() over (partition by w.query_id order by seed, w.path, u.unit_id::varchar) as pos from wk w join su u on u.path = w.path where (w.query_id, u.unit_id) not in (select query_id, unit_id from s10 where rank <= 5)),
bu as ({_TIERS.replace('path', 'unit_id').format("select query_id, unit_id, case when rank <= 5 then rank else 2000000 + rank end as place from s10 union all select query_id, unit_id, 1000000 + pos from nu where pos <= 5", 10)}),
r3a as (select query_id, path, row_number() over (partition by query_id order by min(rank)) as rank from bu join su using (unit_id) group by query_id, path),
{_fused_sql('r4', 60, 'r1', 'r2', 'r3a')}, {_fused_sql('c_flat_hybrid', 60, 'r0', 'c_bm25')}, {_fused_sql('r7f', 30, 'r2s', 'r0')},
kids as (select distinct tm.query_id, d.path from tm join edges e on e.kind = 'child' and e.src = tm.path join docs d on d.path = e.dst and d.doc_type = 'nation'),
hits as ({wiki.HITS}),
r5p as ({_TIERS.format("select k.query_id, k.path, row_number() over (partition by k.query_id order by coalesce(score, 0) desc, k.path) as place from kids k left join r2s using (query_id, path) union all select query_id, path, 1000000 + rank from r2s", 50)}),
r6f as ({_TIERS.format("select h.query_id, h.path, row_number() over (partition by h.query_id order by coalesce(score, 0) desc, h.path) as place from hits h left join r2s using (query_id, path) union all select query_id, path, 1000000 + rank from r2s", 50)}),
r6l as (select * from r6f),
e3 as (select query_id, path, rank from tm where rank <= 3),
nb as (select distinct e3.query_id, n.dst as path from e3 join near n on n.src = e3.path where (e3.query_id, n.dst) not in (select query_id, path from e3)),
np as (select nb.query_id, nb.path, row_number() over (partition by nb.query_id order by coalesce(score, -1) desc, nb.path) as pos from nb left join r1 using (query_id, path)),
r7h as ({_TIERS.format("select query_id, path, rank as place from e3 union all select query_id, path, 1000000 + pos from np union all select query_id, path, 2000000 + rank from r7f", 50)})"""
SQL["arm_matrix"] = f"with {_MATRIX} " + " union all ".join(f"select '{name}' as arm, query_id, path, rank from {name.lower()}" for name in _ARMS)


@query
def arm_noop_guard(spark, sf_dir):
    """For each arm, the questions that it answers and those of them whose first ten documents are the metadata ranking's: an arm that changes nothing shows here."""
    listed = arm_matrix(spark, sf_dir).where("rank <= 10").groupBy("query_id", "arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), ",").alias("docs"))
    base = listed.where("arm = 'R2s'").select("query_id", F.col("docs").alias("base"))
    return listed.where("arm <> 'R2s'").join(base, "query_id", "left").groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("docs").eqNullSafe(F.col("base"))).alias("n_same"))


SQL["arm_noop_guard"] = f"with m as ({SQL['arm_matrix']}), l as (select query_id, arm, string_agg(path, ',' order by rank) as docs from m where rank <= 10 group by 1, 2) select a.arm, count(*) as n, count(*) filter (a.docs is not distinct from b.docs) as n_same from l a left join l b on a.query_id = b.query_id and b.arm = 'R2s' where a.arm <> 'R2s' group by 1"
