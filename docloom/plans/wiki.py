"""Metadata, filter and link queries, over a wiki that the star schema spells out.

Pages: region/R.md, region/R/N.md (nations), region/R/N/supplier-S.md and part/P.md. Child links
follow the directories; prose links join the suppliers and parts of line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, metadata, ranking
from ..operators.lineage import kept
from .base import bm25_sql, ident_sql, table

SQL: dict[str, str] = {}


def wiki_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s, p = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part"))
    region = F.concat(F.lit("region/"), F.col("r_name"))
    nation = F.concat(region, F.lit("/"), F.col("n_name"))
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    row = lambda df, path, parent, kind, title, about, tags: df.select(path.alias("path"), parent.cast("string").alias("parent"), F.lit(kind).alias("doc_type"), title.alias("title"), about.alias("description"), tags.alias("tags"), F.lit("current").alias("status"))
    none = F.lit(None)
    out = row(r, F.concat(region, F.lit(".md")), none, "region", F.col("r_name"), F.lit("region page"), F.array(F.lit("place")))
    out = out.unionByName(row(places, F.concat(nation, F.lit(".md")), F.concat(region, F.lit(".md")), "nation", F.col("n_name"), F.concat(F.lit("nation of "), F.col("r_name")), F.array(F.lit("place"))))
    suppliers = s.join(places, s.s_nationkey == n.n_nationkey)
    out = out.unionByName(row(suppliers, F.concat(nation, F.lit("/supplier-"), F.col("s_suppkey").cast("string"), F.lit(".md")), F.concat(nation, F.lit(".md")), "supplier", F.col("s_name"), F.concat(F.lit("supplier in "), F.col("n_name")), F.array(F.lit("company"))))
    return out.unionByName(row(p, F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".md")), none, "part", F.col("p_name"), F.lower("p_type"), F.array("p_brand")))


_DOCS = """docs as (
  select 'region/' || r_name || '.md' as path, null::varchar as parent, 'region' as doc_type, r_name as title, 'region page' as description, ['place'] as tags from region
  union all select 'region/' || r_name || '/' || n_name || '.md', 'region/' || r_name || '.md', 'nation', n_name, 'nation of ' || r_name, ['place'] from nation join region on n_regionkey = r_regionkey
  union all select 'region/' || r_name || '/' || n_name || '/supplier-' || s_suppkey || '.md', 'region/' || r_name || '/' || n_name || '.md', 'supplier', s_name, 'supplier in ' || n_name, ['company']
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'part/' || p_partkey || '.md', null, 'part', p_name, lower(p_type), [p_brand] from part)"""


def wiki_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wiki_docs(spark, sf_dir)
    child = docs.where("parent is not null").select(F.col("parent").alias("src"), F.col("path").alias("dst"), F.lit("child").alias("kind"))
    at = docs.where("doc_type = 'supplier'").select(F.regexp_extract("path", r"supplier-(\d+)\.md$", 1).cast("long").alias("l_suppkey"), "path")
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey", "l_partkey").distinct()  # few are alike, so no map looks for them
    prose = pairs.join(at, "l_suppkey").select(F.col("path").alias("src"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".md")).alias("dst"), F.lit("prose").alias("kind"))
    return child.unionByName(prose)


_EDGES = f"""{_DOCS},
edges as (select parent as src, path as dst, 'child' as kind from docs where parent is not null union all
  select path, 'part/' || l_partkey || '.md', 'prose' from (select distinct l_suppkey, l_partkey from lineitem) join docs on doc_type = 'supplier' and path like '%/supplier-' || l_suppkey || '.md'),
near as (select distinct src, dst, kind from (select * from edges union all select dst, src, kind from edges) where src <> dst)"""
EDGES = _EDGES[len(_DOCS) + 2 :]  # for queries that have the documents already


def wiki_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of suppliers and parts, and of orders as dated documents (45 days long)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    place = F.concat_ws("/", F.lit("region"), F.col("r_name"), F.col("n_name"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".md")))
    none = F.lit(None).cast("double")
    f = lambda name, kind, vals, num=none: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), vals.alias("vals"), num.cast("double").alias("num"))
    text = lambda c: F.array(c.cast("string"))
    balance = F.floor("s_acctbal")
    own = placed.select(place.alias("path"), F.lit("supplier").alias("doc_type"), F.explode(F.array(
        f("region", "str", text(F.col("r_name"))), f("country", "str", text(F.col("n_name"))), f("balance", "int", text(balance), balance),
        f("in_credit", "bool", text(F.col("s_acctbal") > 5000), (F.col("s_acctbal") > 5000).cast("double")))).alias("x"))
    p = table(spark, sf_dir, "part")
    parts = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.lit("part").alias("doc_type"), F.explode(F.array(
        f("brand", "str", text(F.col("p_brand"))), f("size", "int", text(F.col("p_size")), F.col("p_size")), f("formats", "list", F.split("p_name", " ")))).alias("x"))
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    orders = o.select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.lit("promotion").alias("doc_type"), F.explode(F.array(
        f("start", "date", text(day)), f("end", "date", text(F.date_add(day, 45))), f("store_status", "str", text(F.col("o_orderstatus"))))).alias("x"))
    return own.unionByName(parts).unionByName(orders).select("path", "doc_type", "x.*")


_FIELDS = f"""{_DOCS},
fields as (
  select d.path, 'supplier' as doc_type, x.* from (select s.*, n_name, r_name from supplier s join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) s
    join docs d on d.doc_type = 'supplier' and d.path like '%/supplier-' || s_suppkey || '.md', lateral (values
    ('region', 'str', [r_name], null::double), ('country', 'str', [n_name], null), ('balance', 'int', [floor(s_acctbal)::bigint::varchar], floor(s_acctbal)), ('in_credit', 'bool', [(s_acctbal > 5000)::varchar], (s_acctbal > 5000)::int::double)) x(field, kind, vals, num)
  union all select 'part/' || p_partkey || '.md', 'part', x.* from part, lateral (values ('brand', 'str', [p_brand], null::double), ('size', 'int', [p_size::varchar], p_size::double), ('formats', 'list', string_split(p_name, ' '), null)) x(field, kind, vals, num)
  union all select 'order/' || o_orderkey || '.md', 'promotion', x.* from orders, lateral (values ('start', 'date', [o_orderdate::date::varchar], null::double), ('end', 'date', [(o_orderdate::date + 45)::varchar], null), ('store_status', 'str', [o_orderstatus], null)) x(field, kind, vals, num))"""


def _told_docs(spark, sf_dir) -> DataFrame:
    return wiki_docs(spark, sf_dir).where("doc_type in ('supplier', 'part')")


def meta_pseudo_docs(spark, sf_dir):
    fields = wiki_fields(spark, sf_dir).where("doc_type in ('supplier', 'part')")
    return metadata.pseudo_docs(_told_docs(spark, sf_dir), fields)


def _stem(t: str) -> str:
    from .base import stem_sql

    return stem_sql(t)


_TEXT = """f as (select path, string_agg(field || ' ' || array_to_string(list_transform(vals, lambda v: case v when 'true' then 'yes' when 'false' then 'no' else v end), ' '), ' ' order by field) as s from fields group by path),
whole as (select d.path, concat_ws(' ', title, description, array_to_string(tags, ' '), 'type ' || doc_type, 'status current', s) as t from docs d left join f using (path) where doc_type in ('supplier', 'part'))"""
SQL["meta_pseudo_docs"] = f"with {_FIELDS}, {_TEXT} select path as unit_id, array_to_string({_stem('t')}, ' ') as text from whole"


def meta_pseudo_docs_v1(spark, sf_dir):
    return metadata.pseudo_docs_v1(_told_docs(spark, sf_dir), wiki_fields(spark, sf_dir).where("doc_type in ('supplier', 'part')"))


SQL["meta_pseudo_docs_v1"] = f"""with {_FIELDS}, f as (select path, string_agg(field || ': ' || array_to_string(list_transform(vals, lambda v: case v when 'true' then 'True' when 'false' then 'False' else v end), ', '), chr(10) order by field) as s from fields group by path)
select d.path as unit_id, 'title: ' || title || chr(10) || 'type: ' || doc_type || chr(10) || s as text from docs d join f using (path) where doc_type in ('supplier', 'part')"""

#: Questions about suppliers and parts, and the conditions they state.
QUESTIONS = {
    "w1": "Which suppliers are in ASIA and in credit?",
    "w2": "List the parts of Brand#12 with size over 40",
    "w3": "Which suppliers in NATION_3 have balance of at least 5000?",
    "w4": "small ring parts of size between 10 and 20",
    "w5": "Name suppliers not in EUROPE",
    "w6": "supplier region AMERICA country NATION_1",
}
FILTERS = {
    "w1": [("supplier", "region", "in", ["ASIA"], []), ("supplier", "in_credit", "==", [], [1.0])],
    "w2": [("part", "brand", "in", ["Brand#12"], []), ("part", "size", ">", [], [40.0])],
    "w3": [("supplier", "country", "in", ["NATION_3"], []), ("supplier", "balance", ">=", [], [5000.0])],
    "w4": [("part", "formats", "only", ["small", "ring"], []), ("part", "size", "between", [], [10.0, 20.0])],
    "w5": [("supplier", "region", "not_in", ["EUROPE"], [])],
}
OPS = {
    "in": ("supplier", "region", ["ASIA", "AFRICA"], []), "not_in": ("supplier", "region", ["ASIA"], []), "only": ("part", "formats", ["ring", "small"], []),
    "==": ("part", "size", [], [7.0]), "!=": ("part", "size", [], [7.0]), ">": ("part", "size", [], [45.0]), ">=": ("part", "size", [], [45.0]), "<": ("part", "size", [], [5.0]), "<=": ("part", "size", [], [5.0]),
    "between": ("supplier", "balance", [], [1000.0, 2000.0]), "month_overlap": ("promotion", "start", [], [3.0]), "start_month": ("promotion", "start", [], [11.0]), "end_month": ("promotion", "end", [], [1.0]),
}
_FILTER_TYPE = "query_id string, doc_type string, n int, field string, op string, s array<string>, x array<double>"


def questions(spark) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS.items()), "query_id string, text string")


def filters(spark) -> DataFrame:
    return spark.createDataFrame([(q, t, i, f, op, s, x) for q, own in FILTERS.items() for i, (t, f, op, s, x) in enumerate(own)], _FILTER_TYPE)


ASKED = "select * from (values " + ", ".join(f"('{q}', '{t}')" for q, t in QUESTIONS.items()) + ") t(query_id, text)"


def arm_r2s_all(spark, sf_dir, k: int = 50) -> DataFrame:
    from ..functions.text import normalize_stem

    ranked = ranking.bm25(meta_pseudo_docs(spark, sf_dir), questions(spark), k, tokens=normalize_stem)
    return ranked.withColumnRenamed("unit_id", "path")


def arm_r2s(spark, sf_dir):
    return arm_r2s_all(spark, sf_dir, 10)


def r2s_sql(k: int) -> str:
    units = "select path as unit_id, t as text from whole"
    return f"{_FIELDS}, {_TEXT}, {bm25_sql(units, ASKED, _stem, k)}, r2s as (select query_id, unit_id as path, score, rank from ranked)"


SQL["arm_r2s"] = f"with {r2s_sql(10)} select * from r2s"


def arm_r2(spark, sf_dir):
    return ranking.bm25(meta_pseudo_docs_v1(spark, sf_dir), questions(spark), 10).withColumnRenamed("unit_id", "path")


SQL["arm_r2"] = f"with v1 as ({SQL['meta_pseudo_docs_v1']}), {bm25_sql('select unit_id, text from v1', ASKED, ident_sql, 10)} select query_id, unit_id as path, score, rank from ranked"


def field_types(spark, sf_dir):
    fields = wiki_fields(spark, sf_dir)
    return metadata.field_types(fields.select("path", "doc_type").distinct(), fields)


SQL["field_types"] = f"with {_FIELDS}, n as (select doc_type, count(distinct path) as n from fields group by 1) select doc_type, field, max_by(kind, path) as kind from fields join n using (doc_type) group by doc_type, field, n having 2 * count(distinct path) >= n"
_CATEGORIES = ("region", "country", "store_status", "formats", "brand")


def categorical_values(spark, sf_dir):
    return metadata.categorical_values(wiki_fields(spark, sf_dir), list(_CATEGORIES))


SQL["categorical_values"] = f"with {_FIELDS} select doc_type, field, list_sort(list_distinct(flatten(list(vals)))) as vals from fields where field in {_CATEGORIES} group by 1, 2"


def filter_schema(spark, sf_dir):
    return metadata.filter_schema(field_types(spark, sf_dir), categorical_values(spark, sf_dir))


SQL["filter_schema"] = f"""with t as ({SQL['field_types']}), v as ({SQL['categorical_values']}),
d as (select t.doc_type, t.field, case when vals is not null then case when kind = 'list' then 'list of: ' else 'one of: ' end || array_to_string(vals[1:10], ', ') || case when len(vals) > 10 then ', ...' else '' end
  when kind = 'int' then 'integer' when kind = 'bool' then 'true/false' when kind = 'date' then 'YYYY-MM-DD' end as description from t left join v using (doc_type, field))
select * from d where description is not null"""


def filter_ops(spark, sf_dir):
    filters = spark.createDataFrame([(op, t, 0, f, op, s, x) for op, (t, f, s, x) in OPS.items()], _FILTER_TYPE)
    return metadata.apply_filters(wiki_fields(spark, sf_dir), filters).withColumnRenamed("query_id", "op")


_PARTS = "select '{0}' as op, 'part/' || p_partkey || '.md' as path from part where {1}"
_SUPPLIERS = "select '{0}', 'region/' || r_name || '/' || n_name || '/supplier-' || s_suppkey || '.md' from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where {1}"
_ORDERS = "select '{0}', 'order/' || o_orderkey || '.md' from orders where {1}"
SQL["filter_ops"] = " union all ".join(
    [_PARTS.format(op, f"p_size {sql} {v}") for op, sql, v in (("==", "=", 7), ("!=", "<>", 7), (">", ">", 45), (">=", ">=", 45), ("<", "<", 5), ("<=", "<=", 5))]
    + [_PARTS.format("only", "list_sort(list_distinct(string_split(p_name, ' '))) = ['ring', 'small']"), _SUPPLIERS.format("in", "r_name in ('ASIA', 'AFRICA')"), _SUPPLIERS.format("not_in", "r_name <> 'ASIA'"), _SUPPLIERS.format("between", "floor(s_acctbal) between 1000 and 2000")]
    + [_ORDERS.format("month_overlap", "month(o_orderdate) <= 3 and month(o_orderdate::date + 45) >= 3"), _ORDERS.format("start_month", "month(o_orderdate) = 11"), _ORDERS.format("end_month", "month(o_orderdate::date + 45) = 1")]
)


def filter_apply(spark, sf_dir):
    return metadata.apply_filters(wiki_fields(spark, sf_dir), filters(spark))


HITS = " union all ".join(
    [_SUPPLIERS.format("w1", "r_name = 'ASIA' and s_acctbal > 5000").replace("select 'w1',", "select 'w1' as query_id,").replace("'.md' from", "'.md' as path from"), _PARTS.format("w2", "p_brand = 'Brand#12' and p_size > 40"), _SUPPLIERS.format("w3", "n_name = 'NATION_3' and floor(s_acctbal) >= 5000"),
     _PARTS.format("w4", "list_sort(list_distinct(string_split(p_name, ' '))) = ['ring', 'small'] and p_size between 10 and 20"), _SUPPLIERS.format("w5", "r_name <> 'EUROPE'")]
)
SQL["filter_apply"] = HITS


def filter_rank(spark, sf_dir):
    return metadata.tiered(filter_apply(spark, sf_dir), kept(arm_r2s_all(spark, sf_dir), "ranked"))


_TIERED = """h as (select hits.query_id, hits.path, coalesce(score, 0) as score from hits left join r2s using (query_id, path)),
t as (select query_id, path, 0 as tier, row_number() over (partition by query_id order by score desc, path) as pos from h union all select query_id, path, 1, rank from r2s),
m as (select query_id, path, min(tier * 1000000 + pos) as place from t group by all)
select query_id, path, rank from (select *, row_number() over (partition by query_id order by place) as rank from m) where rank <= 50"""
SQL["filter_rank"] = f"with {r2s_sql(50)}, hits as ({HITS}), {_TIERED}"


def meta_oracle(spark, sf_dir):
    fields = wiki_fields(spark, sf_dir)
    exact = metadata.metadata_oracle(fields, "formats", ["ring", "small"], "exact_set").withColumn("op", F.lit("exact_set"))
    return exact.unionByName(metadata.metadata_oracle(fields, "formats", ["red"], "contains").withColumn("op", F.lit("contains")))


SQL["meta_oracle"] = "select 'part/' || p_partkey || '.md' as path, 'exact_set' as op from part where list_sort(list_distinct(string_split(p_name, ' '))) = ['ring', 'small'] union all select 'part/' || p_partkey || '.md', 'contains' from part where list_contains(string_split(p_name, ' '), 'red')"


def hier_oracle(spark, sf_dir):
    docs = wiki_docs(spark, sf_dir)
    direct = metadata.under(docs, "region/ASIA/").withColumn("scope", F.lit("direct"))
    return direct.unionByName(metadata.under(docs, "region/ASIA/", True).withColumn("scope", F.lit("all")))


SQL["hier_oracle"] = f"with {_DOCS} select path, 'direct' as scope from docs where path like 'region/ASIA/%' and path not like 'region/ASIA/%/%' union all select path, 'all' from docs where path like 'region/ASIA/%'"


def adjacency(spark, sf_dir):
    found = graph.adjacency(wiki_edges(spark, sf_dir))
    return found.select("path", F.size("neighbours").cast("long").alias("n"), F.md5(F.array_join("neighbours", ",").cast("binary")).alias("neighbours_md5"))


SQL["adjacency"] = f"with {_EDGES} select src as path, count(distinct dst) as n, md5(array_to_string(list_sort(list_distinct(list(dst))), ',')) as neighbours_md5 from near group by src"


def children_by_parent(spark, sf_dir):
    return graph.children_by_parent(wiki_edges(spark, sf_dir))


SQL["children_by_parent"] = f"with {_EDGES} select src as path, list_sort(list_distinct(list(dst))) as children from edges where kind = 'child' group by src"


def _supplier_ranking(spark, sf_dir) -> DataFrame:
    return arm_r2s_all(spark, sf_dir, 20)


def graph_bfs(spark, sf_dir):
    seeds = _supplier_ranking(spark, sf_dir).where("rank <= 3").select("query_id", "path", "rank")
    return graph.bfs(seeds, wiki_edges(spark, sf_dir).where("kind = 'child'"), 2).select("query_id", "path", F.col("seed").cast("long").alias("seed"), F.col("hop").cast("long").alias("hop"))


SQL["graph_bfs"] = f"""with {r2s_sql(20)}, {EDGES},
cn as (select distinct src, dst from near where kind = 'child'),
h0 as (select query_id, path, min(rank) as seed, 0 as hop from r2s where rank <= 3 group by all),
h1 as (select query_id, dst as path, min(seed) as seed, 1 as hop from h0 join cn on src = path where (query_id, dst) not in (select query_id, path from h0) group by query_id, dst),
h2 as (select query_id, dst as path, min(seed) as seed, 2 as hop from h1 join cn on src = path where (query_id, dst) not in (select query_id, path from h0 union all select query_id, path from h1) group by query_id, dst)
select query_id, path, seed, hop::bigint as hop from (select * from h0 union all select * from h1 union all select * from h2)"""


def graph_expand_weighted(spark, sf_dir):
    return graph.expand_weighted(_supplier_ranking(spark, sf_dir), wiki_edges(spark, sf_dir))


SQL["graph_expand_weighted"] = f"""with {r2s_sql(20)}, {EDGES},
b as (select query_id, path, rank, score / max(score) over (partition by query_id) as s from r2s),
w as (select src, dst, max(case kind when 'child' then 1.0::double else 0.6::double end) as w from near group by all),
l as (select query_id, dst as path, max(0.25::double * w * s) as loan from b join w on src = path where rank <= 5 group by query_id, dst),
m as (select query_id, path, case when rank <= 5 then rank else 1073741824 end as seed, round(coalesce(s, 0) + coalesce(loan, 0), 9) as score from b full join l using (query_id, path))
select query_id, path, score, rank from (select *, row_number() over (partition by query_id order by score desc, seed, path) as rank from m) where rank <= 50"""


def graph_doc_expand(spark, sf_dir):
    return graph.expand_docs(_supplier_ranking(spark, sf_dir), wiki_edges(spark, sf_dir))


SQL["graph_doc_expand"] = f"""with {r2s_sql(20)}, {EDGES},
n as (select r.query_id, dst as path, row_number() over (partition by r.query_id order by r.rank, dst) as pos from r2s r join (select distinct src, dst from near) e on e.src = r.path where r.rank <= 5),
t as (select query_id, path, case when rank <= 5 then rank else 2000000 + rank end as place from r2s union all select query_id, path, 1000000 + pos from n),
m as (select query_id, path, min(place) as place from t group by all)
select query_id, path, rank from (select query_id, path, row_number() over (partition by query_id order by place) as rank from m) where rank <= 50"""


def title_match(spark, sf_dir):
    return graph.title_match(questions(spark), wiki_docs(spark, sf_dir))


TITLES = f"""tt as (select path, {_stem('title')} as t from docs), qq as (select query_id, ' ' || array_to_string({_stem('text')}, ' ') || ' ' as q from ({ASKED})),
tm as (select query_id, path, len(t)::bigint as n_words, row_number() over (partition by query_id order by len(t) desc, path) as rank from qq join tt on contains(q, ' ' || array_to_string(t, ' ') || ' '))"""
SQL["title_match"] = f"with {_DOCS}, {TITLES} select * from tm"


def parent_aware(spark, sf_dir):
    wanted = questions(spark).select("query_id", F.lit("nation").alias("doc_type"))
    kids = graph.parent_aware(title_match(spark, sf_dir), wanted, wiki_docs(spark, sf_dir), wiki_edges(spark, sf_dir))
    return metadata.tiered(kids, kept(arm_r2s_all(spark, sf_dir), "ranked"))


SQL["parent_aware"] = f"""with {r2s_sql(50)}, {EDGES}, {TITLES},
hits as (select distinct tm.query_id, d.path from tm join edges e on e.kind = 'child' and e.src = tm.path join docs d on d.path = e.dst and d.doc_type = 'nation'), {_TIERED}"""


def two_step(spark, sf_dir):
    fallback = kept(arm_r2s_all(spark, sf_dir), "ranked")
    similarity = fallback.select("query_id", "path", "score")
    return graph.two_step(title_match(spark, sf_dir), wiki_edges(spark, sf_dir), similarity, fallback.select("query_id", "path", "rank"))


SQL["two_step"] = f"""with {r2s_sql(50)}, {EDGES}, {TITLES},
e3 as (select query_id, path, rank from tm where rank <= 3),
nb as (select distinct e3.query_id, n.dst as path from e3 join near n on n.src = e3.path where (e3.query_id, n.dst) not in (select query_id, path from e3)),
np as (select nb.query_id, nb.path, row_number() over (partition by nb.query_id order by coalesce(score, -1) desc, nb.path) as pos from nb left join r2s using (query_id, path)),
t as (select query_id, path, rank as place from e3 union all select query_id, path, 1000000 + pos from np union all select query_id, path, 2000000 + rank from r2s),
m as (select query_id, path, min(place) as place from t group by all)
select query_id, path, rank from (select query_id, path, row_number() over (partition by query_id order by place) as rank from m) where rank <= 50"""


def parent_chain(spark, sf_dir):
    return graph.parent_chain(wiki_docs(spark, sf_dir), wiki_edges(spark, sf_dir))


SQL["parent_chain"] = f"""with recursive {_EDGES}, up as (select dst, min(src) as src from edges where kind = 'child' group by dst),
c as (select path, path as root, 0 as depth from docs union all select c.path, up.src, depth + 1 from c join up on up.dst = c.root)
select path, max_by(root, depth) as root, max(depth)::bigint as depth, true as ok from c group by path"""


def edge_agreement(spark, sf_dir):
    edges = wiki_edges(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    at = wiki_docs(spark, sf_dir).where("doc_type = 'supplier'").select(F.regexp_extract("path", r"supplier-(\d+)\.md$", 1).cast("long").alias("l_suppkey"), "path")
    returned = items.join(at, "l_suppkey").select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".md")).alias("src"), F.col("path").alias("dst"), F.lit("prose").alias("kind"))
    return graph.edge_agreement(edges, returned)


SQL["edge_agreement"] = f"""with {_EDGES}, a as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst),
r as (select distinct least(path, 'part/' || l_partkey || '.md') as a, greatest(path, 'part/' || l_partkey || '.md') as b from (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R') join docs on doc_type = 'supplier' and path like '%/supplier-' || l_suppkey || '.md'),
s as (select count(*) as n from a join r using (a, b))
select (select count(*) from a) as n_one, (select count(*) from r) as n_two, n as shared, round(n / (select count(*) from r), 6) as precision, round(n / (select count(*) from a), 6) as recall from s"""


def edge_path_join(spark, sf_dir):
    """Links with the titles and types of both ends."""
    docs, edges = wiki_docs(spark, sf_dir), wiki_edges(spark, sf_dir)
    end = lambda c: docs.select(F.col("path").alias(c), F.col("title").alias(f"{c}_title"), F.col("doc_type").alias(f"{c}_type"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", "kind", "src_title", "dst_title", "src_type", "dst_type")


SQL["edge_path_join"] = f"with {_EDGES} select e.src, e.dst, e.kind, a.title as src_title, b.title as dst_title, a.doc_type as src_type, b.doc_type as dst_type from edges e join docs a on a.path = e.src join docs b on b.path = e.dst"


def doc_edges(spark, sf_dir):
    """Links into and out of one document."""
    path = "region/ASIA.md"
    edges = wiki_edges(spark, sf_dir)
    return edges.where((F.col("src") == path) | (F.col("dst") == path)).select("src", "dst", "kind", F.when(F.col("src") == path, "out").otherwise("in").alias("direction"))


SQL["doc_edges"] = f"with {_EDGES} select src, dst, kind, case when src = 'region/ASIA.md' then 'out' else 'in' end as direction from edges where src = 'region/ASIA.md' or dst = 'region/ASIA.md'"


def bundle_index(spark, sf_dir):
    """A line for each document, under each directory above it: what an index page lists."""
    docs = wiki_docs(spark, sf_dir).select("path", "title")
    parts = F.split("path", "/")
    above = docs.withColumn("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    lines = above.withColumn("line", F.format_string("* [%s](/%s)", "title", "path"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"])
    return lines.groupBy("directory").agg(F.count("*").alias("n_docs"), F.md5(F.array_join(listed, "\n").cast("binary")).alias("index_md5"))


SQL["bundle_index"] = f"""with {_DOCS}, a as (select path, title, string_split(path, '/') as p from docs), d as (select path, title, unnest(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/'))) as directory from a)
select coalesce(directory, '') as directory, count(*) as n_docs, md5(string_agg('* [' || title || '](/' || path || ')', chr(10) order by path)) as index_md5 from d group by 1"""


def bundle_validate(spark, sf_dir):
    """Directories without an index document of their own name, and documents without a type or title."""
    docs = wiki_docs(spark, sf_dir)
    parts = F.split("path", "/")
    above = docs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("directory")).distinct()
    missing = above.join(docs.select(F.regexp_replace("path", r"\.md$", "").alias("directory")), "directory", "left_anti").select(F.lit("no index").alias("problem"), F.col("directory").alias("path"))
    blank = docs.where((F.coalesce(F.trim("doc_type"), F.lit("")) == "") | (F.coalesce(F.trim("title"), F.lit("")) == "")).select(F.lit("no type or title").alias("problem"), "path")
    return missing.unionByName(blank)


SQL["bundle_validate"] = f"""with {_DOCS}, a as (select distinct unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as directory from docs)
select 'no index' as problem, directory as path from a where directory not in (select regexp_replace(path, '\\.md$', '') from docs) union all select 'no type or title', path from docs where coalesce(trim(doc_type), '') = '' or coalesce(trim(title), '') = ''"""

QUERIES = {f.__name__: f for f in (meta_pseudo_docs, meta_pseudo_docs_v1, arm_r2, arm_r2s, field_types, categorical_values, filter_schema, filter_ops, filter_apply, filter_rank, meta_oracle, hier_oracle, adjacency, children_by_parent, graph_bfs, graph_expand_weighted, graph_doc_expand, title_match, parent_aware, two_step, parent_chain, edge_agreement, edge_path_join, doc_edges, bundle_index, bundle_validate)}
