"""Gold sets over the star schema, store operations and validation queries."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, store
from .base import table

SQL: dict[str, str] = {}
QUERIES: dict = {}

#: Gold statements: the tables' names stand in braces, parameters are question marks.
GOLD: dict[str, tuple[str, list]] = {
    "gold_filter_eq": ("select s_suppkey as id from {supplier} where s_nationkey = ?", [3]),
    "gold_filter_neq": ("select s_suppkey as id from {supplier} where s_nationkey <> ?", [3]),
    "gold_filter_conj": ("select p_partkey as id from {part} where p_brand = ? and p_type = ? and p_size < ?", ["Brand#12", "PROMO", 25]),
    "gold_filter_range": ("select p_partkey as id, 'after' as kind from {part} where p_size > ? union all select p_partkey, 'before' from {part} where p_size < ? union all select p_partkey, 'between' from {part} where p_size between ? and ? union all select p_partkey, 'brand' from {part} where p_brand = ? and p_size >= ?", [45, 4, 20, 22, "Brand#7", 40]),
    "gold_distinct": ("select distinct l_suppkey as id from {lineitem} where l_returnflag = ?", ["R"]),
    "gold_anti": ("select distinct o_custkey as id from {orders} where o_custkey not in (select o_custkey from {orders} where o_orderstatus <> ?)", ["O"]),
    "gold_semi": ("select c_custkey as id from {customer} where c_nationkey in (select n_nationkey from {nation} where n_regionkey in (?, ?)) and c_mktsegment = ?", [1, 2, "BUILDING"]),
    "gold_having": ("select o_custkey as id from {orders} where o_orderpriority in (?, ?) group by o_custkey having count(distinct o_orderpriority) = 2", ["1-URGENT", "2-HIGH"]),
    "gold_parents": ("select distinct n_regionkey as id from {nation} where n_nationkey in (select s_nationkey from {supplier} where s_acctbal > ?)", [9000]),
    "gold_point_lookup": ("select s_suppkey as id, s_name as answer from {supplier} where s_suppkey = ? union all select p_partkey, p_brand from {part} where p_partkey = ? union all select n_nationkey, n_name from {nation} where n_nationkey = ?", [5, 17, 4]),
    "gold_two_hop": ("select s_suppkey as id, n_name as nation, r_name as region from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey", []),
    "gold_hierarchy": ("select c_custkey as id from {customer} join {nation} on c_nationkey = n_nationkey where n_regionkey in (?, ?) and c_mktsegment <> ?", [0, 3, "MACHINERY"]),
    "gold_month_overlap": ("select o_orderkey as id, 'overlap' as kind from {orders} where cast(o_orderdate as date) <= ? and cast(o_orderdate as date) + interval '45' day >= ? union all select o_orderkey, 'start' from {orders} where cast(o_orderdate as date) between ? and ?", ["1997-03-31", "1997-03-01", "1997-11-01", "1997-11-30"]),
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _gold(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    sql, params = GOLD[key]
    named = {t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql}
    import datetime
    import re

    own = [datetime.date.fromisoformat(p) if isinstance(p, str) and re.fullmatch(r"\d{4}-\d\d-\d\d", p) else p for p in params]
    return gold.run_gold(spark, sql, own, **named)


def _literal(key: str) -> str:
    sql, params = GOLD[key]
    for t in _TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    for p in params:
        date = isinstance(p, str) and len(p) == 10 and p[4] == p[7] == "-"
        sql = sql.replace("?", (f"date '{p}'" if date else f"'{p}'") if isinstance(p, str) else str(p), 1)
    return sql


for _key in GOLD:
    QUERIES[_key] = partial(_gold, key=_key)
    SQL[_key] = _literal(_key)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def gold_absent(spark, sf_dir):
    """Terms that no document holds, whatever the case."""
    terms = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("word")).distinct()
    # a term inside a longer word counts as held: distinct words, not texts, meet the terms
    held = words.join(terms, F.contains("word", "term")).select("term").distinct()
    return terms.join(held, "term", "left_anti")


SQL["gold_absent"] = "select distinct term from (select unnest(string_split(p_name, ' ')) as term from part) where not exists (select 1 from documents where contains(lower(text), term))"


@query
def gold_span(spark, sf_dir):
    """The first line of each document that holds both needles."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("the")) & F.contains(x, F.lit("and")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.get(lines, F.lit(0)).cast("binary")).alias("span_md5")).where("span_md5 is not null")


SQL["gold_span"] = "select doc_id, md5(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the') and contains(x, 'and'))[1]) as span_md5 from documents where len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the') and contains(x, 'and'))) > 0"


@query
def gold_recheck(spark, sf_dir):
    """A stored set, with one row too many and some missing, against its statement."""
    fresh = _gold(spark, sf_dir, "gold_filter_eq")
    stored = fresh.where("id % 5 <> 0").unionByName(spark.createDataFrame([(-1,)], "id bigint"))
    return gold.recheck(stored, fresh, "id")


SQL["gold_recheck"] = f"""with fresh as ({_literal('gold_filter_eq')}), stored as (select id from fresh where id % 5 <> 0 union all select -1),
missing as (select id from fresh except select id from stored), stale as (select id from stored except select id from fresh)
select id, 'missing' as problem from missing union all select id, 'stale' from stale"""


@query
def quarterly_pivot(spark, sf_dir):
    """Sales of each supplier and return flag by quarters of 13 weeks, as columns."""
    rows = table(spark, sf_dir, "lineitem")
    quarter = F.least(F.floor((F.weekofyear("l_shipdate") - 1) / 13), F.lit(3)) + 1
    sums = [F.round(F.sum(F.when(quarter == q, F.col("l_extendedprice"))), 2).alias(f"q{q}") for q in range(1, 5)]
    return rows.groupBy("l_suppkey", "l_returnflag").agg(*sums, F.count("*").alias("n"))


SQL["quarterly_pivot"] = "with l as (select *, least((week(l_shipdate) - 1) // 13, 3) + 1 as q from lineitem) select l_suppkey, l_returnflag, " + ", ".join(f"round(sum(l_extendedprice) filter (q = {q}), 2) as q{q}" for q in range(1, 5)) + ", count(*) as n from l group by all"


@query
def upsert_latest(spark, sf_dir):
    """The latest event of each user and type, the second half of the events being incoming."""
    events = table(spark, sf_dir, "events")
    return store.upsert_latest(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id", "value")


SQL["upsert_latest"] = "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id % 2 desc, ts desc, event_id desc) as r from events) where r = 1"


def _links(spark, sf_dir, name: str, provenance: str) -> DataFrame:
    t = table(spark, sf_dir, "nation")
    pairs = t.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("child").alias("kind"))
    return pairs.withColumn("provenance", F.lit(provenance))


@query
def edge_refresh(spark, sf_dir):
    """Authored links of some nations replaced; one incoming link has an unknown end; extracted links stay."""
    stored = _links(spark, sf_dir, "n", "authored").unionByName(_links(spark, sf_dir, "n", "extracted"))
    incoming = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), ((F.col("n_regionkey") + 3) % 7).cast("string")).alias("dst"), F.lit("curated").alias("kind"))
    known = stored.select(F.col("src").alias("path")).union(stored.select("dst")).distinct()
    return store.refresh_edges(stored, incoming, known, "authored")


SQL["edge_refresh"] = """with s as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'child' as kind, p as provenance from nation, (values ('authored'), ('extracted')) v(p)),
k as (select src as path from s union select dst from s),
i as (select 'n' || n_nationkey as src, 'r' || ((n_regionkey + 3) % 7) as dst, 'curated' as kind, 'authored' as provenance from nation where n_nationkey < 5)
select * from s where not (provenance = 'authored' and src in (select src from i)) union all select * from i where src in (select path from k) and dst in (select path from k)"""


@query
def embedding_load_checks(spark, sf_dir):
    """Checks of vectors with planted faults: repeated ids, null vectors, unknown ids and mismatched documents."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"), F.col("embedding").alias("vector"))
    chunks = rows.select("chunk_id", "doc_id").where("chunk_id % 97 <> 5")
    faulty = rows.withColumn("vector", F.when(F.col("chunk_id") % 100 != 7, F.col("vector"))).withColumn("doc_id", F.when(F.col("chunk_id") % 50 == 3, F.col("doc_id") + 1).otherwise(F.col("doc_id")))
    return store.vector_checks(faulty.unionByName(faulty.where("chunk_id < 4")), chunks)


SQL["embedding_load_checks"] = """with chunks as (select vec_id as chunk_id, label::bigint as doc_id from embeddings where vec_id % 97 <> 5),
f as (select vec_id as chunk_id, case when vec_id % 50 = 3 then label + 1 else label end::bigint as doc_id, case when vec_id % 100 <> 7 then embedding end as vector from embeddings), v as (select * from f union all select * from f where chunk_id < 4)
select 'missing column' as check, (select count(*) from (values ('chunk_id'), ('doc_id'), ('vector')) need(c) where c not in ('chunk_id', 'doc_id', 'vector')) as n_bad union all select 'duplicate id', (select count(*) from (select chunk_id from v group by 1 having count(*) > 1))
union all select 'null vector', (select count(*) from v where vector is null) union all select 'unknown id', (select count(*) from v anti join chunks using (chunk_id)) union all select 'document mismatch', (select count(*) from v join chunks using (chunk_id) where v.doc_id is distinct from chunks.doc_id)"""


@query
def vector_freshness(spark, sf_dir):
    """Pairs of chunk and document in vectors but not in chunks, or the other way."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"))
    moved = rows.withColumn("doc_id", F.when(F.col("chunk_id") % 40 == 0, F.col("doc_id") + 100).otherwise(F.col("doc_id")))
    return store.pair_difference(rows, moved, "chunk_id", "doc_id")


SQL["vector_freshness"] = "select vec_id as chunk_id, label::bigint as doc_id, 'only stored' as side from embeddings where vec_id % 40 = 0 union all select vec_id, label + 100, 'only expected' from embeddings where vec_id % 40 = 0"


@query
def corpus_map(spark, sf_dir):
    """Turns by role of each conversation, and whether its one user turn and one assistant turn are equal."""
    rows = table(spark, sf_dir, "conversations")
    one = lambda role: F.count_if(F.col("role") == role)
    same = F.min(F.when(F.col("role") == "user", F.col("text"))) == F.min(F.when(F.col("role") == "assistant", F.col("text")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), one("user").alias("n_user"), one("assistant").alias("n_assistant"), F.coalesce((one("user") == 1) & (one("assistant") == 1) & same, F.lit(False)).alias("identical"))


SQL["corpus_map"] = """select conv_id, count(*) as n_turns, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant,
  coalesce(count(*) filter (role = 'user') = 1 and count(*) filter (role = 'assistant') = 1 and min(text) filter (role = 'user') = min(text) filter (role = 'assistant'), false) as identical from conversations group by conv_id"""


@query
def chunk_doc_join(spark, sf_dir):
    """Chunks with their documents' columns."""
    from ..operators.chunking import chunk_flat

    docs = table(spark, sf_dir, "documents")
    chunks = chunk_flat(docs.select("doc_id", "text"), 200, 20).select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("text").cast("long").alias("n_chars_chunk"))
    return chunks.join(docs.select("doc_id", "lang", "source"), "doc_id")


SQL["chunk_doc_join"] = r"""with w as (select doc_id, lang, source, regexp_extract_all(text, '[^\t\n\v\f\r ]+') as ws from documents),
s as (select *, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 200) / 180.0)::bigint))) as ord from w where len(ws) > 0)
select doc_id, ord, length(array_to_string(ws[ord * 180 + 1 : ord * 180 + 200], ' ')) as n_chars_chunk, lang, source from s"""


@query
def chunk_overlap(spark, sf_dir):
    """Pairs of user and assistant turns of one conversation that share eight characters in a row."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), "role", "text")
    return store.shared_shingles(rows.where("role = 'user'"), rows.where("role = 'assistant'"))


SQL["chunk_overlap"] = """with g as (select distinct conv_id, turn, role, unnest(list_transform(range(1, length(text) - 6), lambda i: substr(text, i, 8))) as gram from conversations where length(text) >= 8)
select distinct a.conv_id as doc, a.turn as left_id, b.turn as right_id from g a join g b on a.conv_id = b.conv_id and a.gram = b.gram and a.role = 'user' and b.role = 'assistant'"""


@query
def dup_basename(spark, sf_dir):
    """Last path segments of pages that stand on more than one page."""
    name = F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return table(spark, sf_dir, "pages").select(name.alias("basename")).groupBy("basename").agg(F.count("*").alias("n")).where("n > 1")


SQL["dup_basename"] = r"select regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) as basename, count(*) as n from pages group by 1 having count(*) > 1"


@query
def dup_title(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)", 1))
    return table(spark, sf_dir, "pages").groupBy(title.alias("title")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


SQL["dup_title"] = "select trim(regexp_extract(html, '<title>([^<]*)', 1)) as title, count(*) as n, min(page_id) as first_page from pages group by 1 having count(*) > 1"


@query
def corpus_diff(spark, sf_dir):
    """Documents as stored and as rendered again: missing, extra or different."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    stored = docs.where("doc_id % 11 <> 0")
    fresh = docs.where("doc_id % 13 <> 0").withColumn("h", F.when(F.col("doc_id") % 17 == 0, F.lit("x")).otherwise(F.col("h")))
    joined = stored.join(fresh.withColumnRenamed("h", "g"), "doc_id", "full")
    return joined.select("doc_id", F.when(F.col("h").isNull(), "missing").when(F.col("g").isNull(), "extra").when(F.col("h") != F.col("g"), "mismatch").alias("problem")).where("problem is not null")


SQL["corpus_diff"] = """with stored as (select doc_id, md5(text) as h from documents where doc_id % 11 <> 0), fresh as (select doc_id, case when doc_id % 17 = 0 then 'x' else md5(text) end as g from documents where doc_id % 13 <> 0)
select doc_id, case when h is null then 'missing' when g is null then 'extra' else 'mismatch' end as problem from stored full join fresh using (doc_id) where h is null or g is null or h <> g"""


@query
def required_keys(spark, sf_dir):
    """Keys that an event's properties lack."""
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(F.lit("k"), F.lit("v")), keys)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(lacking), ",").alias("lacking")).where("lacking <> ''")


SQL["required_keys"] = "select event_id, array_to_string(list_sort(list_filter(['k', 'v'], lambda x: not list_contains(json_keys(props), x))), ',') as lacking from events where len(list_filter(['k', 'v'], lambda x: not list_contains(json_keys(props), x))) > 0"


@query
def dangling_links(spark, sf_dir):
    """Links of pages to root paths that no page has."""
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1)))).alias("href"))
    paths = pages.select(F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "/$", "").alias("href")).distinct()
    return hrefs.join(paths, "href", "left_anti").select("page_id", "href")


SQL["dangling_links"] = r"""with h as (select distinct page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) as href from pages)
select * from h where href not in (select regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/$', '') from pages)"""


@query
def filler_lint(spark, sf_dir):
    """Documents that may not serve as filler: digits, a length other than 60 to 160 words, or a part's word in them."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    named = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("word")).join(names, "word", "left_semi").select("doc_id").distinct().withColumn("_named", F.lit(True))
    marked = docs.join(named, "doc_id", "left")
    problems = F.array_compact(F.array(F.when(F.col("text").rlike("[0-9]"), F.lit("digits")), F.when(~F.col("n").between(60, 160), F.lit("length")), F.when(F.col("_named"), F.lit("name"))))
    return marked.select("doc_id", F.array_join(problems, ",").alias("problems")).where("problems <> ''")


SQL["filler_lint"] = r"""with p as (select distinct unnest(string_split(p_name, ' ')) as w from part), n as (select distinct doc_id from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) join p using (w)),
x as (select doc_id, concat_ws(',', case when regexp_matches(text, '[0-9]') then 'digits' end, case when len(regexp_extract_all(text, '[^\t\n\v\f\r ]+')) not between 60 and 160 then 'length' end, case when doc_id in (select doc_id from n) then 'name' end) as problems from documents)
select * from x where problems <> ''"""


@query
def name_containment(spark, sf_dir):
    """Distinct part names whose words stand inside another name."""
    names = table(spark, sf_dir, "part").select(F.explode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("name")).distinct()
    words = names.select(F.col("name").alias("other"), F.explode(F.split("name", " ")).alias("name"))
    return names.join(words, "name").where("name <> other").select("name", "other").distinct()


SQL["name_containment"] = "with n as (select distinct unnest(list_append(string_split(p_name, ' '), p_name)) as name from part) select a.name, b.name as other from n a join n b on a.name <> b.name and list_contains(string_split(b.name, ' '), a.name)"


@query
def span_check(spark, sf_dir):
    """Benchmark items that are not a line of any document, by hashes of lines."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    return table(spark, sf_dir, "benchmark").join(lines, "text", "left_anti").select("item_id")


SQL["span_check"] = "select item_id from benchmark where text not in (select unnest(string_split(text, chr(10))) from documents)"


@query
def text_disjoint(spark, sf_dir):
    """Texts, normalised, that two sets of documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace("text", r"[\t\n ]+", " "))).cast("binary")).alias("h"))
    return docs.where("doc_id % 2 = 0").select("h").intersect(docs.where("doc_id % 2 = 1").select("h")).withColumnRenamed("h", "text_md5")


SQL["text_disjoint"] = r"with d as (select doc_id, md5(lower(trim(regexp_replace(text, '[\t\n ]+', ' ', 'g'), ' '))) as h from documents) select h as text_md5 from d where doc_id % 2 = 0 intersect select h from d where doc_id % 2 = 1"


@query
def ngram_overlap(spark, sf_dir):
    """Benchmark items and how many of their word 4-grams some conversation turn holds."""
    grams = lambda df, key: df.select(key, F.split("text", " ").alias("w")).where("size(w) >= 4").select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " ")))).alias("gram"))
    items = grams(table(spark, sf_dir, "benchmark"), "item_id")
    turns = grams(table(spark, sf_dir, "documents"), "doc_id").select("gram").join(items.select("gram").distinct(), "gram", "left_semi").distinct()
    return items.join(turns, "gram").groupBy("item_id").agg(F.count("*").alias("n_shared"))


_G4 = "list_transform(range(1, len(string_split(text, ' ')) - 2), lambda i: array_to_string(string_split(text, ' ')[i : i + 3], ' '))"
SQL["ngram_overlap"] = f"with i as (select distinct item_id, unnest({_G4}) as gram from benchmark), d as (select distinct unnest({_G4}) as gram from documents) select item_id, count(*) as n_shared from i join d using (gram) group by item_id"


@query
def paraphrase_pairs(spark, sf_dir):
    """Conversation turns without the turn that answers them."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return asked.join(answers, ["conv_id", "turn"], "left_anti")


SQL["paraphrase_pairs"] = "select conv_id, turn from conversations c where role = 'user' and not exists (select 1 from conversations a where a.role = 'assistant' and a.conv_id = c.conv_id and a.turn = c.turn + 1)"


@query
def question_checks(spark, sf_dir):
    """Conversations whose turns do not count up from 0, or that lack a role."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.min("turn").alias("first"), F.count_distinct("turn").alias("d"), F.count_distinct("role").alias("n_roles"))
    return own.select("conv_id", ((F.col("n") == F.col("d")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)).alias("counted"), "n_roles").where("not counted or n_roles < 2")


SQL["question_checks"] = "select conv_id, (count(*) = count(distinct turn) and min(turn) = 0 and max(turn) = count(*) - 1) as counted, count(distinct role) as n_roles from conversations group by conv_id having not (count(*) = count(distinct turn) and min(turn) = 0 and max(turn) = count(*) - 1) or count(distinct role) < 2"


@query
def corpus_fingerprint(spark, sf_dir):
    """SHA-256 of each source's documents, by id, from the digests of their texts: by thousands, then by millions, then of those."""
    found = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("part"), F.col("doc_id").alias("at"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    n = F.lit(1).cast("long").alias("n")
    found = found.select("source", "part", "at", "h", n)
    for level in (1000, None, None):
        line = lambda x: F.concat(x["at"].cast("string"), F.lit(" "), x["h"])
        digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), line), "\n").cast("binary"), 256)
        found = found.groupBy("source", "part").agg(digest.alias("h"), F.sum("n").alias("n"))
        found = found.select("source", (F.floor(F.col("part") / 1000) if level else F.lit(0).cast("long")).alias("part"), F.col("part").alias("at"), "h", "n")
    return found.select("source", F.col("h").alias("sha256"), F.col("n").alias("n_docs"))


_LEVEL = "select source, {1} as part, part as k, sha256(string_agg(k || ' ' || h, chr(10) order by k)) as h, sum(n)::bigint as n from {0} group by source, part"
SQL["corpus_fingerprint"] = f"""with a as (select source, doc_id // 1000 as part, doc_id as k, sha256(text) as h, 1 as n from documents),
b as ({_LEVEL.format('a', 'part // 1000')}), c as ({_LEVEL.format('b', '0::bigint')}), d as ({_LEVEL.format('c', '0::bigint')}) select source, h as sha256, n as n_docs from d"""


_MANIFEST = (("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("embeddings", "vec_id", "label"), ("conversations", "conv_id", "text"))


@query
def run_manifest(spark, sf_dir):
    """Row counts and an order-free hash of the tables that a run reads: of each row the first 15 hexadecimal digits of its MD5, summed."""
    parts = []
    for name, key, value in _MANIFEST:
        digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(value).cast("string")).cast("binary")), 1, 15)
        parts.append(table(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(F.conv(digits, 16, 10).cast("decimal(38,0)")).cast("string").alias("hash")))
    return reduce(DataFrame.unionByName, parts)


SQL["run_manifest"] = " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, sum(('0x' || md5(concat_ws(':', {k}, {v}))[1:15])::bigint::hugeint)::varchar as hash from {t}" for t, k, v in _MANIFEST)
