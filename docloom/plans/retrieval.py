"""Text functions, lexical and dense ranking, fusion and chunking, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, gold, lexical_index, ranking, vector_index
from ..operators.lineage import cut, shared_path
from .base import bm25_sql, ident_sql, stem_sql, table

SQL: dict[str, str] = {}


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_U, _Q = "select doc_id as unit_id, text from documents", "select item_id as query_id, text from benchmark"


def tokenize_ident(spark, sf_dir):
    tokens = T.tokenize_ident(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens_md5"))


SQL["tokenize_ident"] = f"select doc_id, len({ident_sql('text')})::bigint as n_tokens, md5(array_to_string({ident_sql('text')}, ' ')) as tokens_md5 from documents"


def normalize_stem(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.lit("part").alias("source"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("document").alias("source"))
    return parts.unionByName(docs).select("source", "id", F.md5(F.array_join(T.normalize_stem(F.col("text")), " ").cast("binary")).alias("terms_md5"))


SQL["normalize_stem"] = f"""select source, id, md5(array_to_string({stem_sql('text')}, ' ')) as terms_md5 from (
  select 'part' as source, p_partkey as id, concat_ws(' ', p_name, p_type, p_brand) as text from part union all select 'document', doc_id, text from documents)"""


def bm25_stats(spark, sf_dir):
    rows, stats = ranking.bm25_stats(_units(spark, sf_dir))
    terms = rows.select("unit_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count_distinct("unit_id").alias("df"), F.count("*").alias("cf"))
    return terms.crossJoin(F.broadcast(stats.select("n_units", F.round("avg_terms", 6).alias("avg_terms"))))  # stats is one row


SQL["bm25_stats"] = f"""with u as (select doc_id, {ident_sql('text')} as ts from documents), s as (select count(*) as n_units, round(avg(len(ts)), 6) as avg_terms from u)
select term, count(distinct doc_id) as df, count(*) as cf, n_units, avg_terms from (select doc_id, unnest(ts) as term from u), s group by all"""


def bm25_topk(spark, sf_dir):
    return ranking.bm25(_units(spark, sf_dir), _questions(spark, sf_dir), 10)


SQL["bm25_topk"] = f"with {bm25_sql(_U, _Q, ident_sql, 10)} select query_id, unit_id, score, rank from ranked"


_KEPT: dict[tuple[str, str, str], object] = {}


def _once(spark, sf_dir, name: str, make):
    """What make gives, made once for each table and session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _index(spark, sf_dir, name: str, tokens) -> lexical_index.Index:
    """The index of the documents' words."""
    return _once(spark, sf_dir, f"words {name}", lambda: lexical_index.build(_units(spark, sf_dir), tokens=tokens))


def bm25_index_topk(spark, sf_dir):
    """bm25_topk from the index: blocks of postings whose bounds cannot reach the first ten are not read."""
    return lexical_index.search(_index(spark, sf_dir, "ident", T.tokenize_ident), _questions(spark, sf_dir), 10)


SQL["bm25_index_topk"] = SQL["bm25_topk"]


def bm25_index_bounds(spark, sf_dir):
    """How many postings each question's words have, from the blocks' sizes alone."""
    found = lexical_index.bounds(_index(spark, sf_dir, "ident", T.tokenize_ident), _questions(spark, sf_dir))
    return found.groupBy("query_id").agg(F.sum("n").alias("n_postings"))


SQL["bm25_index_bounds"] = f"""with {bm25_sql(_U, _Q, ident_sql, 10)} select query_id, count(*)::bigint as n_postings from q join po using (term) group by query_id"""


def collapse_docs(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("unit_id"), "text")
    ranked = ranking.bm25(units, _questions(spark, sf_dir), 50)
    ranked = ranked.withColumn("doc", F.substring_index("unit_id", "-", 1).cast("long"))
    return ranking.collapse(ranked, "doc", 10)


_CONV = "select conv_id || '-' || turn as unit_id, text from conversations"
SQL["collapse_docs"] = f"""with {bm25_sql(_CONV, _Q, ident_sql, 50)},
f as (select query_id, split_part(unit_id, '-', 1)::bigint as doc, min(rank) as r from ranked group by all)
select * from (select query_id, doc, row_number() over (partition by query_id order by r) as rank from f) where rank <= 10"""


def gold_containment(spark, sf_dir):
    """Benchmark items contained whole in documents."""
    return gold.containment(_units(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", F.col("unit_id").alias("doc_id"))


SQL["gold_containment"] = "select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text) where length(b.text) > 0"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").cast("long").alias("doc"), "embedding")


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_DENSE = """q as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % 50 = 0),
d as (select query_id, vec_id as unit_id, label::bigint as doc, round(list_inner_product(qe, embedding::double[]), 6) + 0.0::double as score from q, embeddings)"""


def dense_topk(spark, sf_dir):
    return ranking.dense_topk(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10)


SQL["dense_topk"] = f"with {_DENSE} select * from (select query_id, unit_id, score, row_number() over (partition by query_id order by score desc, unit_id) as rank from d) where rank <= 10"


def dense_doc_max(spark, sf_dir):
    return ranking.dense_doc_max(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), "doc", "unit_id")


SQL["dense_doc_max"] = f"with {_DENSE} select query_id, doc, max(score) as score from d group by all"


def arm_r0(spark, sf_dir):
    return ranking.dense_docs(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), "doc", "unit_id", 5)


SQL["arm_r0"] = f"""with {_DENSE}, r as (select *, row_number() over (partition by query_id order by score desc, unit_id) as r from d),
f as (select query_id, doc, max(score) as score, min(r) as r from r group by all)
select * from (select query_id, doc, score, row_number() over (partition by query_id order by r) as rank from f) where rank <= 5"""


def ann_lsh(spark, sf_dir):
    """Approximate neighbours by random-projection buckets, then exact distances. A query that finds fewer than ten is answered by all vectors; tests hold the recall to 0.9."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    tables = 8
    vectors = _vectors(spark, sf_dir)
    rows = vectors.select("unit_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=tables, seed=7).fit(rows)
    coded = model.transform(rows).select("unit_id", "embedding", F.array(*[vector_to_array(F.col("hashes")[i])[0].cast("int") for i in range(tables)]).alias("codes"))
    queries = _vector_queries(spark, sf_dir)
    # unit vectors share so many buckets that their pairs cannot be rows
    found = cut(ranking.bucketed_topk(coded, coded.where("unit_id % 50 = 0").withColumnRenamed("unit_id", "query_id"), 10, 1.3))
    full = found.groupBy("query_id").count().where("count = 10")
    # the vectors are of length 1, so the nearest are those of the largest inner products
    rest = ranking.dense_topk(vectors, queries.join(full, "query_id", "left_anti"), 10).withColumn("distance", F.round(F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))), 6))
    return found.join(full, "query_id", "left_semi").unionByName(rest.select(found.columns))


def _vector_index(spark, sf_dir) -> vector_index.Index:
    """The index of the vectors, built once for each table and session."""
    return _once(spark, sf_dir, "vectors", lambda: vector_index.build(_vectors(spark, sf_dir).select("unit_id", "embedding")))


def ann_cells(spark, sf_dir):
    """Approximate neighbours from the probed cells of the vector index; tests hold the recall to 0.9."""
    return vector_index.search(_vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), 10)


def ann_cells_exact(spark, sf_dir):
    """dense_topk from the vector index: cells whose bounds cannot reach the first ten are not read."""
    return vector_index.search(_vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), 10, exact=True)


SQL["ann_cells_exact"] = SQL["dense_topk"]


def _two_rankings(spark, sf_dir) -> DataFrame:
    """Lexical rankings of whole documents, by identifiers and by stems, saved once for each table and session."""

    def save() -> str:
        both = ranking.bm25s(_units(spark, sf_dir), _questions(spark, sf_dir), {"ident": T.tokenize_ident, "stem": T.normalize_stem}, 50)
        both.select("query_id", F.col("unit_id").alias("doc"), "rank", "ranking").write.parquet(path := shared_path(spark, "two-rankings"))
        return path

    return spark.read.parquet(_once(spark, sf_dir, "two rankings", save))


_TWO = f"""{bm25_sql(_U, _Q, ident_sql, 50)},
{bm25_sql(_U, _Q, stem_sql, 50, "_s")},
both_ as (select query_id, unit_id as doc, rank, 'ident' as ranking from ranked union all select query_id, unit_id, rank, 'stem' from ranked_s)"""


def rrf(spark, sf_dir):
    return ranking.rrf(_two_rankings(spark, sf_dir), 60, 10)


def _rrf_sql(k: int, cut: int) -> str:
    return f"""with {_TWO}, f as (select query_id, doc, round(sum(1.0::double / ({k} + rank)), 9) as score from both_ group by all)
select * from (select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc) as rank from f) where rank <= {cut}"""


SQL["rrf"] = _rrf_sql(60, 10)


def arm_hybrid(spark, sf_dir):
    """Dense and lexical rankings of labels: vectors as chunks of their label, labels named in words."""
    words = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("unit_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text")).distinct()
    queries = _vector_queries(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("find label "), F.col("label").cast("string")).alias("text"))
    lexical = ranking.bm25(words, asked, 50).select("query_id", F.col("unit_id").alias("doc"), "rank", F.lit("lexical").alias("ranking"))
    dense = ranking.dense_docs(_vectors(spark, sf_dir), queries, "doc", "unit_id", 50).select("query_id", F.col("doc").cast("string").alias("doc"), "rank", F.lit("dense").alias("ranking"))
    return ranking.rrf(lexical.unionByName(dense), 60, 5)


_WORDS = "select distinct label::varchar as unit_id, 'label ' || label as text from embeddings"
_ASKED = "select vec_id as query_id, 'find label ' || label as text from embeddings where vec_id % 50 = 0"
SQL["arm_hybrid"] = f"""with {bm25_sql(_WORDS, _ASKED, ident_sql, 50)},
vq as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % 50 = 0),
d as (select query_id, vec_id, label::varchar as doc, round(list_inner_product(qe, embedding::double[]), 6) as score from vq, embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from d),
f as (select query_id, doc, row_number() over (partition by query_id order by min(r)) as rank from r group by query_id, doc),
b as (select query_id, unit_id as doc, rank from ranked union all select query_id, doc, rank from f where rank <= 50),
z as (select query_id, doc, round(sum(1.0::double / (60 + rank)), 9) as score from b group by all)
select * from (select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc) as rank from z) where rank <= 5"""


def context_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    title, path = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.array("role", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    led = F.when(F.col("turn") % 2 == 0, F.concat(F.array(title), path)).otherwise(path)
    return rows.select("conv_id", "turn", F.md5(T.context_text(title, path, F.col("text")).cast("binary")).alias("context_md5"), F.md5(T.heading_path_text(title, led, F.col("text")).cast("binary")).alias("path_md5"))


SQL["context_text"] = """select conv_id, turn, md5('Conversation ' || conv_id || ' > ' || role || ' > turn ' || turn || chr(10) || text) as context_md5,
  md5(role || ' > turn ' || turn || chr(10) || text) as path_md5 from conversations"""


def chunk_flat(spark, sf_dir):
    chunks = chunking.chunk_flat(table(spark, sf_dir, "documents").select("doc_id", "text"), 512, 50)
    return chunks.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["chunk_flat"] = r"""with w as (select doc_id, regexp_extract_all(text, '[^\t\n\v\f\r ]+') as ws from documents),
s as (select doc_id, ws, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 512) / 462.0)::bigint))) as ord from w where len(ws) > 0)
select doc_id, ord, md5(array_to_string(ws[ord * 462 + 1 : ord * 462 + 512], ' ')) as text_md5 from s"""


def _ranked_conversations(spark, sf_dir) -> DataFrame:
    return collapse_docs(spark, sf_dir)


def evidence_order(spark, sf_dir):
    sections = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"))
    return chunking.evidence_order(_ranked_conversations(spark, sf_dir), sections, 20).select("query_id", "doc", "ord", "position")


_COLLAPSED = SQL["collapse_docs"].replace("select * from (select query_id, doc", ", c as (select * from (select query_id, doc", 1) + ")"
_EVIDENCE = f"""{_COLLAPSED},
e as (select c.query_id, c.doc, c.rank, v.turn as ord, v.text, row_number() over (partition by c.query_id, c.doc order by v.turn) as place from c join conversations v on v.conv_id = c.doc),
p as (select *, row_number() over (partition by query_id order by place, rank) as position from e)"""
SQL["evidence_order"] = f"{_EVIDENCE} select query_id, doc, ord, position from p where position <= 20"


def pack_context(spark, sf_dir):
    sections = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text")
    passages = chunking.evidence_order(_ranked_conversations(spark, sf_dir), sections, 20).withColumn("path", F.concat(F.lit("conv-"), F.col("doc").cast("string")))
    packed = chunking.pack_context(passages, 512)
    listed = chunking.numbered_documentation(packed)
    totals = packed.groupBy("query_id").agg(F.sum("tokens").alias("tokens_in"))
    return listed.join(totals, "query_id").select("query_id", "n_passages", "tokens_in", F.md5(F.col("documentation").cast("binary")).alias("documentation_md5"))


SQL["pack_context"] = rf"""{_EVIDENCE},
s as (select query_id, position, 'conv-' || doc as path, regexp_extract_all(text, '[^\t\n\v\f\r ]+') as ws from p where position <= 20),
b as (select *, 512 - 2 - coalesce(sum(2 + len(ws)) over (partition by query_id order by position rows between unbounded preceding and 1 preceding), 0) as room from s),
k as (select *, least(len(ws), room)::bigint as taken, row_number() over (partition by query_id order by position) as i from b where room > 0)
select query_id, count(*) as n_passages, sum(2 + taken)::bigint as tokens_in, md5(string_agg('[' || i || '] ' || path || chr(10) || array_to_string(ws[1 : taken], ' '), chr(10) || chr(10) order by i)) as documentation_md5 from k group by query_id"""

QUERIES = {f.__name__: f for f in (tokenize_ident, normalize_stem, bm25_stats, bm25_topk, bm25_index_topk, bm25_index_bounds, collapse_docs, gold_containment, dense_topk, dense_doc_max, arm_r0, ann_lsh, ann_cells, ann_cells_exact, rrf, arm_hybrid, context_text, chunk_flat, evidence_order, pack_context)}
