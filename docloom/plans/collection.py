"""Collections as files and bundles, word forms, draws and reports, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import questions as Q
from ..functions import text as T
from ..operators import bundle, chunking, evaluation, graph, store
from ..operators.lineage import shared_path
from ..sources import markdown
from . import retrieval, wiki
from .base import stem_sql, table
from .markup import _MD, _THROUGH, _markdown

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def front_matter(spark, sf_dir):
    """Suppliers as pages with front matter, written and split again; some titles are words that YAML must quote."""
    s = table(spark, sf_dir, "supplier")
    title = F.when(F.col("s_suppkey") % 3 == 0, "yes").when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(": 'a' # \"b\" é"))).otherwise(F.lit("007"))
    front = F.to_json(F.struct(F.lit("supplier").alias("type"), title.alias("title"), F.array("s_name", F.lit("- x")).alias("tags"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("in_credit")))
    page = markdown.front_matter_page(front, F.concat(F.lit("# "), title, F.lit("\n---\nend")))
    split = s.select("s_suppkey", markdown.split_front_matter(page).alias("x"))
    one = lambda key: F.get_json_object("x.front", f"$.{key}")
    return split.select("s_suppkey", one("title").alias("title"), F.array_join(F.from_json(one("tags"), "array<string>"), "|").alias("tags"), one("nation").cast("long").alias("nation"), one("in_credit").alias("in_credit"), F.col("x.body").alias("body"))


_TITLE = """case s_suppkey % 3 when 0 then 'yes' when 1 then s_name || ': ''a'' # "b" é' else '007' end"""
SQL["front_matter"] = f"""select s_suppkey, {_TITLE} as title, s_name || '|- x' as tags, s_nationkey::bigint as nation, case when s_acctbal > 0 then 'true' else 'false' end as in_credit,
  '# ' || {_TITLE} || chr(10) || '---' || chr(10) || 'end' || chr(10) as body from supplier"""


@query
def jsonl_exchange(spark, sf_dir):
    """The benchmark's items, written as JSON lines and read again."""
    path = shared_path(spark, "jsonl")
    markdown.write_jsonl(table(spark, sf_dir, "benchmark").select("text", "item_id"), path)
    return markdown.read_jsonl(spark, path, "item_id string, text string").select("item_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["jsonl_exchange"] = "select item_id::varchar as item_id, md5(text) as text_md5 from benchmark"


def _measure(texts: list[str]) -> list[list[float]]:
    """An encoder's stand-in: code points and spaces."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query
def embedding_job(spark, sf_dir):
    """Turns as chunks: exported for an embedding job, encoded a batch at a time, and the vectors read again."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text", "role")
    chunks, vectors = shared_path(spark, "chunks"), shared_path(spark, "vectors")
    markdown.export_chunks(turns, chunks)
    markdown.embed(spark.read.parquet(chunks), _measure).write.parquet(vectors)
    return spark.read.parquet(vectors).select("chunk_id", "doc_id", F.col("vector")[0].cast("double").alias("n_chars"), F.col("vector")[1].cast("double").alias("n_spaces"))


SQL["embedding_job"] = "select conv_id || '-' || turn as chunk_id, conv_id as doc_id, length(coalesce(text, ''))::double as n_chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::double as n_spaces from conversations"


@query
def bundle_load(spark, sf_dir):
    """The wiki as a bundle, its vectors checked against its chunks: chunks and authored links of each page."""
    docs = wiki.wiki_docs(spark, sf_dir)
    policy = F.explode(F.array(F.lit("flat"), F.lit("struct")))
    chunks = docs.select(F.concat("path", F.lit("#0")).alias("chunk_id"), "path", F.lit(0).alias("ord"), F.col("title").alias("text")).select("*", policy.alias("policy"))
    gone = spark.createDataFrame([("nowhere.md", "part/1.md", "prose", "authored"), ("part/1.md", "part/2.md", "prose", "extracted")], "src string, dst string, kind string, provenance string")
    edges = wiki.wiki_edges(spark, sf_dir).withColumn("provenance", F.lit("authored")).unionByName(gone)
    vectors = chunks.where("policy = 'struct'").select("chunk_id", "path", F.array(F.length("text").cast("float")).alias("vector"))
    loaded = bundle.load(docs, chunks, edges, vectors)
    n_chunks = loaded["chunks"].groupBy("path").agg(F.count("*").alias("n_chunks"), F.count("vector").alias("n_vectors"))
    n_edges = loaded["edges"].groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_edges"))
    return docs.select("path").join(n_chunks, "path").join(n_edges, "path", "left").select("path", "n_chunks", "n_vectors", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


SQL["bundle_load"] = f"with {wiki._EDGES} select path, 2 as n_chunks, 1 as n_vectors, coalesce(n, 0) as n_edges from docs left join (select src, count(*) as n from edges group by src) e on e.src = docs.path"


@query
def page_notes(spark, sf_dir):
    """Parts' pages, with notes appended to those whose file stem has some."""
    p = table(spark, sf_dir, "part")
    pages = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.col("p_name").alias("content"))
    notes = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("stem"), F.concat(F.lit("\n  "), "p_type", F.lit(" \n")).alias("text"))
    return bundle.with_notes(pages, notes).select("path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


SQL["page_notes"] = r"select 'part/' || p_partkey || '.md' as path, md5(p_name || case when p_partkey % 2 = 0 then chr(10) || '## Notes' || chr(10) || chr(10) || trim(p_type) || chr(10) else '' end) as content_md5 from part"


@query
def word_forms(spark, sf_dir):
    """Slugs, possessives and prefixed questions of customers' and nations' names."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    names = c.select(F.concat("c_name", F.lit(" St. "), "c_mktsegment").alias("name")).unionByName(n.select(F.initcap("n_name").alias("name"))).distinct()
    return names.select("name", T.slug(F.col("name")).alias("slug"), T.possessive(F.col("name")).alias("possessive"), T.prefixed(F.col("name"), "Find: ").alias("asked"))


SQL["word_forms"] = """with n as (select distinct name from (select c_name || ' St. ' || c_mktsegment as name from customer union all
  select list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) from nation))
select name, replace(replace(lower(name), ' ', '-'), '.', '') as slug, name || case when name like '%s' then '''' else '''s' end as possessive, 'Find: ' || name as asked from n"""


@query
def english_list(spark, sf_dir):
    """The nations of each region below some number, as a list in words."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = F.array_sort(F.collect_list(F.when(F.col("n_nationkey") < 4 * F.col("r_regionkey"), F.col("n_name"))))
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(names.alias("names")).select("r_name", T.english_list(F.col("names")).alias("listed"))


SQL["english_list"] = """with l as (select r_name, coalesce(list(n_name order by n_name) filter (n_nationkey < 4 * r_regionkey), []) as ns from nation join region on n_regionkey = r_regionkey group by 1)
select r_name, case len(ns) when 0 then '' when 1 then ns[1] when 2 then ns[1] || ' and ' || ns[2] else array_to_string(ns[1:len(ns) - 1], ', ') || ', and ' || ns[len(ns)] end as listed from l"""


@query
def value_pairs(spark, sf_dir):
    """Pairs of the nations of a region, each once."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_set("n_name").alias("names"))
    return n.select("n_regionkey", F.explode(T.pairs(F.col("names"))).alias("x")).select("n_regionkey", "x.*")


SQL["value_pairs"] = "select a.n_regionkey, a.n_name as first, b.n_name as second from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name"


@query
def shuffled(spark, sf_dir):
    """Parts in a seeded order of their brand, large ones first."""
    p = table(spark, sf_dir, "part")
    return evaluation.shuffled(p, "p_brand", "p_partkey", F.col("p_size") > 40, 7).select("p_brand", "p_partkey", "place")


SQL["shuffled"] = "select p_brand, p_partkey, row_number() over (partition by p_brand order by (p_size > 40)::int desc, md5('7:' || p_brand || ':' || p_partkey), p_partkey) as place from part"


@query
def number_parse(spark, sf_dir):
    """Prices and counts written with commas, and what is no number."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "1,2,x").otherwise(F.format_number(F.floor("o_totalprice") * 10, 0))
    return o.select("o_orderkey", Q.whole_number(text).alias("number"))


SQL["number_parse"] = """with t as (select o_orderkey, case when o_orderkey % 5 = 0 then '1,2,x' else format('{:,}', floor(o_totalprice)::bigint * 10) end as text from orders)
select o_orderkey, case when regexp_full_match(text, '[0-9][0-9,]*') then replace(text, ',', '')::bigint end as number from t"""


@query
def commit_shape(spark, sf_dir):
    """Whether revisions are full commits: digests of pages, some cut short, some in capitals, some missing."""
    digest, kind = F.sha1(F.col("url").cast("binary")), F.pmod(F.col("page_id"), F.lit(5))
    revision = F.when(kind == 1, F.substring(digest, 1, 39)).when(kind == 2, F.upper(digest)).when(kind == 3, "main").when(kind != 4, digest)
    return table(spark, sf_dir, "pages").select("page_id", T.is_commit(revision).alias("pinned"))


SQL["commit_shape"] = """with r as (select page_id, case page_id % 5 when 1 then substr(sha1(url), 1, 39) when 2 then upper(sha1(url)) when 3 then 'main' when 0 then sha1(url) end as revision from pages)
select page_id, coalesce(regexp_full_match(revision, '[0-9a-f]{40}'), false) as pinned from r"""


@query
def negation_window(spark, sf_dir):
    """Words of turns that a negation stands close before: four words, and one."""
    tokens = T.normalize_stem(F.concat(F.col("text"), F.lit(" but not in the north or without much of it all the same")))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("tokens"))
    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    count = lambda window: F.size(F.filter(places, lambda i: Q.negated(F.col("tokens"), i, window))).cast("long")
    return own.select("conv_id", "turn", count(4).alias("n_four"), count(1).alias("n_one"))


_NEGATIONS = "[" + ", ".join(f"'{w}'" for w in Q.NEGATIONS) + "]"


def _negated_sql(window: int) -> str:
    return f"len(list_filter(range(1, len(ts) + 1), lambda i: list_has_any(ts[greatest(i - {window}, 1):i - 1], {_NEGATIONS})))::bigint"


SQL["negation_window"] = f"""with t as (select conv_id, turn, {stem_sql("text || ' but not in the north or without much of it all the same'")} as ts from conversations where text is not null)
select conv_id, turn, {_negated_sql(4)} as n_four, {_negated_sql(1)} as n_one from t"""


@query
def fence_membership(spark, sf_dir):
    """Whether code fences hold the places a quarter, a half and three quarters through documents as markdown."""
    docs = _markdown(spark, sf_dir).withColumn("regions", M.fence_regions(F.col("text")))
    at = F.posexplode(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda i: F.floor(F.length("text") * i / 4)))
    return docs.select("doc_id", "regions", at.alias("part", "at")).select("doc_id", F.col("part").cast("long").alias("part"), M.in_region(F.col("regions"), F.col("at")).alias("fenced"))


SQL["fence_membership"] = f"""with {_MD}, s as (select doc_id, length(array_to_string(lines, chr(10))) as n, list_transform(regions, lambda r: {{'a': case when r.f = 1 then 0 else {_THROUGH.format('r.f - 1')} + 1 end, 'z': {_THROUGH.format('r.l')}}}) as spans from fe),
p as (select *, unnest([0, 1, 2]) as part from s)
select doc_id, part::bigint as part, len(list_filter(spans, lambda x: x.a <= n * (part + 1) // 4 and n * (part + 1) // 4 < x.z)) > 0 as fenced from p"""


@query
def edge_weights(spark, sf_dir):
    """Weighted links between the wiki's pages by kind, by the fixed weights and by others."""
    kinds = F.explode(F.array(*map(F.lit, ("child", "curated", "related", "prose", "sibling", "other"))))
    edges = wiki.wiki_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    all_kinds = spark.range(1).select(kinds.alias("kind"))
    own = {"child": 0.5, "other": 0.25}
    return all_kinds.join(edges, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), graph.weight(F.col("kind")).alias("weight"), graph.weight(F.col("kind"), own).alias("own"))


SQL["edge_weights"] = f"""with {wiki._EDGES}, w as (select * from (values ('child', 1.0::double, 0.5::double), ('curated', 1.0, null), ('related', 0.8, null), ('prose', 0.6, null), ('sibling', 0.2, null), ('other', null, 0.25)) t(kind, weight, own))
select kind, coalesce(n, 0) as n, weight, own from w left join (select kind, count(*) as n from edges group by kind) using (kind)"""


@query
def extract_totals(spark, sf_dir):
    """What a model's graph answers come to: pages as prompts, answers with their links, some cut off."""
    raw = F.concat(F.lit('{"parent": "'), "n_name", F.lit('", "mentions": ["'), "s_name", F.lit('", "'), "s_name", F.lit('", "nobody"]}'))
    given = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    said = F.when(F.col("s_suppkey") % 4 == 0, raw.substr(F.lit(1), F.length(raw) - 4)).otherwise(raw)
    rows = given.select(F.col("s_suppkey").cast("string").alias("path"), F.concat(F.lit("Links of "), "s_name").alias("prompt"), said.alias("raw"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.lit("nation").alias("target")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.lit("supplier").alias("target")))
    return bundle.extraction_totals(rows, titles)


SQL["extract_totals"] = r"""with r as (select s_suppkey::varchar as path, s_suppkey % 4 <> 0 as whole, s_name, n_name, '{"parent": "' || n_name || '", "mentions": ["' || s_name || '", "' || s_name || '", "nobody"]}' as raw from supplier join nation on s_nationkey = n_nationkey),
a as (select *, case when whole then raw else raw[1:length(raw) - 4] end as said from r),
t as (select n_name as title, 'nation' as target from nation union all select s_name, 'supplier' from supplier),
l as (select distinct path, unnest(list_concat([regexp_extract(said, '"parent": "([^"]*)"', 1)], regexp_extract_all(regexp_extract(said, '"mentions": \[(.*)', 1), '"([^"]*)"', 1))) as title from a),
e as (select count(target) as edges, count(*) - count(target) as unknown_titles from l left join t on lower(t.title) = lower(l.title) where target is null or target <> path)
select count(*) as docs, max(edges) as edges, count(*) filter (said like '{%]}') as parse_ok, max(unknown_titles) as unknown_titles,
  sum(len(regexp_extract_all('Links of ' || s_name, '[^\t\n\v\f\r ]+')))::bigint as prompt_tokens, sum(len(regexp_extract_all(said, '[^\t\n\v\f\r ]+')))::bigint as completion_tokens from a, e"""


@query
def efficiency(spark, sf_dir):
    """Latencies by event type as by arm, with the sizes of what each reads."""
    timings = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.abs("value").alias("seconds"))
    sizes = table(spark, sf_dir, "embeddings").groupBy().agg(F.sum(4 * F.size("embedding")).alias("dense_bytes")).select(F.lit("click").alias("arm"), "dense_bytes")
    return evaluation.efficiency(timings, sizes)


SQL["efficiency"] = """with s as (select sum(4 * len(embedding))::bigint as b from embeddings)
select event_type as arm, count(*) as queries, round(quantile_cont(abs(value) * 1000, 0.5), 3) as p50_ms, round(quantile_cont(abs(value) * 1000, 0.95), 3) as p95_ms, case when event_type = 'click' then max(b) else 0 end as dense_bytes from events, s group by 1"""


@query
def basename_conflicts(spark, sf_dir):
    """Names of parts' pages that stand twice in their tree, or once outside it."""
    p = table(spark, sf_dir, "part")
    tree = p.select(F.concat(F.lit("part/"), "p_brand", F.lit("/"), (F.col("p_partkey") % 150).cast("string"), F.lit(".md")).alias("path"))
    others = table(spark, sf_dir, "supplier").select(F.concat(F.lit("notes/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path")).unionByName(tree)
    return store.basename_conflicts(tree, others, "part")


SQL["basename_conflicts"] = """with t as (select p_partkey % 150 || '.md' as basename from part), n as (select basename, count(*) as n from t group by 1)
select basename, 'twice' as conflict, n from n where n > 1 union all select basename, 'outside', count(*) from n join supplier on s_suppkey || '.md' = basename group by 1"""


@query
def chunk_flat_counter(spark, sf_dir):
    """As chunk_flat, with the words counted by a function."""
    chunks = chunking.chunk_flat_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda t: len(t.split()), 512, 50)
    return chunks.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["chunk_flat_counter"] = retrieval.SQL["chunk_flat"]


@query
def pack_context_tokenizer(spark, sf_dir):
    """Contexts packed by a tokenizer's ids, whose stand-in takes a word for an id."""
    passages = retrieval.evidence_order(spark, sf_dir).join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text"), ["doc", "ord"])
    passages = passages.select("query_id", F.col("position").cast("long").alias("position"), F.concat(F.lit("conv-"), F.col("doc").cast("string")).alias("path"), "text")
    packed = chunking.pack_context_tokens(passages, str.split, " ".join, 512)
    return packed.select("query_id", "n_passages", "tokens", "clipped", F.md5(F.col("context").cast("binary")).alias("context_md5"))


SQL["pack_context_tokenizer"] = rf"""{retrieval._EVIDENCE},
s as (select query_id, position, 'conv-' || doc as path, text, regexp_extract_all(text, '[^\t\n\v\f\r ]+') as ws from p where position <= 20 and text <> ''),
b as (select *, 512 - 2 - coalesce(sum(2 + len(ws)) over (partition by query_id order by position rows between unbounded preceding and 1 preceding), 0) as room from s),
k as (select *, least(len(ws), room)::bigint as taken from b where room > 0)
select query_id, count(*) as n_passages, sum(2 + taken)::bigint as tokens, bool_or(taken < len(ws)) as clipped,
  md5(string_agg(chr(10) || 'Source: ' || path || chr(10) || case when taken < len(ws) then array_to_string(ws[1 : taken], ' ') else text end, '' order by position)) as context_md5 from k group by query_id"""


@query
def parent_leaks(spark, sf_dir):
    """Suppliers' pages that must not say their region, by how some still do."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    kind = F.pmod(F.col("s_suppkey"), F.lit(7))
    docs = placed.select(
        F.col("s_suppkey").cast("string").alias("path"), F.when(kind == 6, "region").otherwise("supplier").alias("doc_type"), F.when(kind.isin(1, 6), F.array("s_name", "r_name")).when(kind != 0, F.array("n_name")).alias("tags"),
        F.to_json(F.struct("s_acctbal", F.when(kind.isin(2, 3, 6), F.col("r_name")).alias("region"), F.when(kind == 3, F.lit("x.md")).alias("parent"))).alias("fm"),
        F.concat("s_name", F.when(kind == 4, F.lit(". Part of [its parent page](/x.md).")).otherwise("")).alias("body"),
    )
    return store.parent_leaks(docs, {"supplier": "region"}, r.select(F.lit("supplier").alias("doc_type"), F.col("r_name").alias("name")))


SQL["parent_leaks"] = """with k as (select *, s_suppkey % 7 as kind from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
d as (select s_suppkey::varchar as path, case when kind = 6 then 'region' else 'supplier' end as doc_type, case when kind in (1, 6) then [s_name, r_name] when kind <> 0 then [n_name] end as tags,
  case when kind in (2, 3, 6) then r_name end as region, case when kind = 3 then 'x.md' end as parent, s_name || case when kind = 4 then '. Part of [its parent page](/x.md).' else '' end as body from k)
select path, unnest(list_filter([case when region is not null then 'field' end, case when parent is not null then 'parent' end, case when contains(body, 'Part of [its parent page](') then 'link' end], lambda x: x is not null)) as leak from d where doc_type = 'supplier'
union all select distinct path, 'tag' from d, region where doc_type = 'supplier' and list_contains(tags, r_name)"""
