"""Jobs over whole tables: generation for every packed context, ingest by increments, bundles as a data source, comparisons of stored trees."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import chunking, digest_tree, generation
from ..operators.lineage import shared_path
from ..sources import bundle_source as bundle_source_files
from ..streaming import ingest
from . import retrieval
from .base import table

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _stand_in() -> generation.Model:
    """A model's stand-in: tells a prompt's words and its first and last, and fails on every fifth number of words, whatever else is in the batch."""

    def model(prompts: list[str]) -> list[str]:
        words = [re.findall(r"[^\t\n\v\f\r ]+", p) for p in prompts]
        if any(len(w) % 5 == 0 for w in words):
            raise ValueError("a multiple of five")
        return [f"{len(w)} words to {w[-1]}" for w in words]

    return model


@query
def generate_answers(spark, sf_dir):
    """An answer, or the error, for every question over its packed context."""
    passages = retrieval.evidence_order(spark, sf_dir).join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text"), ["doc", "ord"])
    packed = chunking.pack_context(passages.withColumn("path", F.concat(F.lit("conv-"), F.col("doc").cast("string"))), 512)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    prompts = generation.prompts_of(questions, chunking.numbered_documentation(packed), "Answer.")
    return generation.generate(prompts, _stand_in, "stand-in").select("query_id", "answer", "error", F.col("n_tokens").cast("long").alias("n_tokens"))


_PACKED = retrieval.SQL["pack_context"].replace("select query_id, count(*) as n_passages", ", dc as (select query_id, count(*) as n_passages", 1)
_PACKED = re.sub(r"md5\((string_agg\(.*\))\) as documentation_md5 from k group by query_id$", r"\1 as documentation from k group by query_id)", _PACKED)
SQL["generate_answers"] = rf"""{_PACKED},
pr as (select item_id as query_id, regexp_extract_all('Answer.' || chr(10) || chr(10) || coalesce(documentation, '') || chr(10) || chr(10) || 'Question: ' || coalesce(text, ''), '[^\t\n\v\f\r ]+') as ws from benchmark left join dc on dc.query_id = item_id)
select query_id, case when len(ws) % 5 <> 0 then len(ws) || ' words to ' || ws[len(ws)] end as answer, case when len(ws) % 5 = 0 then 'ValueError: a multiple of five' end as error, len(ws)::bigint as n_tokens from pr"""


def _page_files(spark, sf_dir):
    """Documents as pages in three waves (path, content, version, wave): all of them; a third with a link to the next; and a seventh of them removed."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md"))
    linked = F.concat("text", F.lit("\n[next](/d/"), (F.col("doc_id") + 1).cast("string"), F.lit(".md)\n"))
    wave = lambda n, where, content: docs.where(where).select(path.alias("path"), content.cast("binary").alias("content"), F.lit(n).cast("long").alias("version"))
    return [wave(0, "true", F.col("text")), wave(1, "doc_id % 3 = 0", linked), wave(2, "doc_id % 7 = 0", F.lit(None).cast("string"))]


@query
def incremental_ingest(spark, sf_dir):
    """The state of a store after pages came in by micro-batches, a third of them twice and a seventh removed at last."""
    source, place, checkpoint = (shared_path(spark, x) for x in ("arriving", "store", "ingest-checkpoint"))
    for files in _page_files(spark, sf_dir):
        files.write.mode("append").parquet(source)
    store = ingest.Store(spark, place, 200, 20)
    ingest.ingest(ingest.file_stream(spark, source, 4), store, checkpoint).awaitTermination()
    chunks = store.chunks().groupBy("path").agg(F.count("*").alias("n_chunks"))
    links = store.edges().where("kind = 'prose'").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_links"))
    found = store.documents().join(chunks, "path", "left").join(links, "path", "left")
    return found.select("path", "version", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_chunks", "n_links")], F.md5(F.col("body").cast("binary")).alias("body_md5"))


SQL["incremental_ingest"] = r"""with d as (select doc_id, (doc_id % 3 = 0)::int::bigint as version, text || case when doc_id % 3 = 0 then chr(10) || '[next](/d/' || (doc_id + 1) || '.md)' || chr(10) else '' end as body
  from documents where text is not null and doc_id % 7 <> 0),
w as (select *, len(regexp_extract_all(body, '[^\t\n\v\f\r ]+')) as n from d)
select 'd/' || doc_id || '.md' as path, version, (case when n = 0 then 0 else 1 + greatest(ceil((n - 200) / 180.0), 0) end)::bigint as n_chunks,
  (version = 1 and exists (select 1 from d x where x.doc_id = w.doc_id + 1))::int::bigint as n_links, md5(body) as body_md5 from w"""


@query
def bundle_source(spark, sf_dir):
    """Parts and suppliers as a bundle, written, and some of its pages read by type and path through the data source: chunks, links and vectors of each."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    text = lambda *c: F.concat_ws(" ", *c)
    pages = part.select(F.concat(F.lit("part/"), "p_partkey", F.lit(".md")).alias("path"), F.lit("part").alias("doc_type"), F.col("p_name").alias("title"), text("p_name", "p_type", "p_brand").alias("body"))
    pages = pages.unionByName(supplier.select(F.concat(F.lit("supplier/"), "s_suppkey", F.lit(".md")).alias("path"), F.lit("supplier").alias("doc_type"), F.col("s_name").alias("title"), F.col("s_name").alias("body")))
    docs = pages.select("*", F.lit(None).cast("string").alias("description"), F.array("doc_type").alias("tags"), F.lit("current").alias("status"), F.lit("{}").alias("fm"))
    chunks = chunking.chunk_flat(pages.select("path", F.col("body").alias("text")), 3, 1).select(F.concat_ws("-", "path", "ord").alias("chunk_id"), "path", F.lit("flat").alias("policy"), "ord", "text")
    vectors = chunks.select("chunk_id", "path", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    edges = sold.select(F.concat(F.lit("part/"), "l_partkey", F.lit(".md")).alias("src"), F.concat(F.lit("supplier/"), "l_suppkey", F.lit(".md")).alias("dst"), F.lit("prose").alias("kind"), F.lit("authored").alias("provenance"))
    bundle_source_files.write(place := shared_path(spark, "bundle"), docs, chunks, edges, {"flat": vectors}, 500)
    read = lambda name, **more: bundle_source_files.read(spark, place, name, **more)
    asked = read("docs").where("doc_type = 'part' and path like 'part/1%'")
    own = read("chunks").where("path like 'part/1%' and policy = 'flat'").join(read("vectors", policy="flat").where("path like 'part/1%'"), ["chunk_id", "path"])
    counted = own.groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum(F.col("vector")[0].cast("long")).alias("n_chars"))
    linked = read("edges").where("src like 'part/1%'").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_links"))
    return asked.join(counted, "path", "left").join(linked, "path", "left").select("path", "title", "n_chunks", "n_chars", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


SQL["bundle_source"] = r"""with p as (select 'part/' || p_partkey || '.md' as path, p_name as title, p_partkey, regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '[^\t\n\v\f\r ]+') as ws from part where p_partkey::varchar like '1%'),
c as (select path, array_to_string(ws[i * 2 + 1 : i * 2 + 3], ' ') as text from p, range(1000) as r(i) where i < 1 + greatest(ceil((len(ws) - 3) / 2.0), 0)),
n as (select path, count(*) as n_chunks, sum(length(text))::bigint as n_chars from c group by path), l as (select l_partkey, count(distinct l_suppkey) as n_links from lineitem group by l_partkey)
select p.path, title, n_chunks, n_chars, coalesce(n_links, 0)::bigint as n_links from p left join n using (path) left join l on l_partkey = p_partkey"""


@query
def corpus_tree_diff(spark, sf_dir):
    """corpus_diff by two stored trees of digests: only what lies below differing nodes is read."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    changed = F.when(F.col("doc_id") % 17 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    stored = digest_tree.build(docs.where("doc_id % 11 <> 0"), depth=2)
    fresh = digest_tree.build(docs.where("doc_id % 13 <> 0").withColumn("content", changed), depth=2)
    return digest_tree.compare(stored, fresh).select(F.col("path").cast("long").alias("doc_id"), "problem")


SQL["corpus_tree_diff"] = """with stored as (select doc_id, sha256(text) as h from documents where text is not null and doc_id % 11 <> 0),
fresh as (select doc_id, sha256(case when doc_id % 17 = 0 then text || 'x' else text end) as g from documents where text is not null and doc_id % 13 <> 0)
select doc_id, case when h is null then 'missing' when g is null then 'extra' else 'mismatch' end as problem from stored full join fresh using (doc_id) where h is null or g is null or h <> g"""


@query
def corpus_tree_nodes(spark, sf_dir):
    """The first level of the tree of documents: digests from the leaves up, and the documents below each."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return digest_tree.build(docs, depth=2).nodes(1).select("node", "digest", F.col("n").alias("n_files"))


SQL["corpus_tree_nodes"] = """with f as (select sha256(doc_id::varchar)[1:2] as node, doc_id::varchar as path, sha256(text) as h from documents where text is not null),
l as (select node, sha256(string_agg(path || chr(0) || h, chr(10) order by path)) as h, count(*) as n from f group by node)
select node[1:1] as node, sha256(string_agg(node || chr(0) || h, chr(10) order by node)) as digest, sum(n)::bigint as n_files from l group by 1"""
