"""A benchmark of the star schema's wiki: questions allotted to sets, the retrieval arms over all of them, and the verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, question_sets, ranking
from ..operators.arms import run_arms
from ..operators.lineage import cut, shared_path
from . import arms, retrieval, scoring, wiki
from .base import bm25_sql, ident_sql, table

SQL: dict[str, str] = {}
QUERIES: dict = {}
EACH = 20  # questions of a kind in a set
SMALLEST, LARGEST = 2, 30  # gold documents of a set question


def query(f):
    QUERIES[f.__name__] = f
    return f


def candidates(spark, sf_dir) -> DataFrame:
    """What can be asked of the wiki: cand, stratum, kind, keys, usable, priority, text_t, text_p, gold, and the conditions of set questions (doc_type, conditions)."""
    fields = wiki.wiki_fields(spark, sf_dir).where("doc_type in ('supplier', 'part')")
    docs = wiki.wiki_docs(spark, sf_dir).select("path", "title", "parent")
    one = lambda name, c: fields.where(F.col("field") == name).select("path", c.alias(name))
    s = docs.join(one("country", F.col("vals")[0]), "path").join(one("region", F.col("vals")[0]), "path").join(one("in_credit", F.col("num") == 1), "path")
    p = docs.join(one("brand", F.col("vals")[0]), "path").join(one("size", F.col("num").cast("long")), "path")
    condition = "struct<field: string, op: string, s: array<string>, x: array<double>>"
    none = F.array().cast(f"array<{condition}>")

    def rows(df, stratum, kind, cand, keys, text_t, text_p, gold, doc_type=F.lit(None).cast("string"), conditions=none, usable=F.lit(True), priority=F.lit(False)) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{kind}:"), cand).alias("cand"), F.lit(stratum).alias("stratum"), F.lit(kind).alias("kind"), keys.alias("keys"), usable.alias("usable"), priority.alias("priority"),
            F.concat(*text_t).alias("text_t"), F.concat(*text_p).alias("text_p"), gold.alias("gold"), doc_type.alias("doc_type"), conditions.alias("conditions"),
        )

    text, fit = F.lit, F.size("gold").between(SMALLEST, LARGEST)
    equal = lambda name, value: F.struct(F.lit(name).alias("field"), F.lit("in").alias("op"), F.array(value).alias("s"), F.array().cast("array<double>").alias("x"))
    number = lambda name, op, x: F.struct(F.lit(name).alias("field"), F.lit(op).alias("op"), F.array().cast("array<string>").alias("s"), F.array(x.cast("double")).alias("x"))
    members = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_set("path")).alias("gold"))
    own = F.array(F.concat(F.lit("supplier "), "path"), F.concat(F.lit("country "), "country"))
    out = rows(s, "S1", "s1_balance", F.col("path"), own, (text("What is the balance of "), "title", text("?")), (text("Tell the account balance that "), "title", text(" has.")), F.array("path"), priority=F.col("in_credit"))
    out = out.unionByName(rows(s, "S2", "s2_region", F.col("path"), own, (text("Which region is the country of "), "title", text(" in?")), (text("In what region does "), "title", text(" have its country?")), F.array("path", "parent")))
    out = out.unionByName(rows(p, "S1", "s1_size", F.col("path"), F.array(F.concat(F.lit("part "), "path"), F.concat(F.lit("brand "), "brand")), (text("What size is the "), "title", text(" of "), "brand", text("?")), (text("How large is "), "brand", text(" "), "title", text("?")), F.array("path")))
    credit = members(s.where("in_credit"), "country")
    out = out.unionByName(rows(credit, "S3", "s3_credit", F.col("country"), F.array(F.concat(F.lit("country "), "country")), (text("Which suppliers in "), "country", text(" are in credit?")), (text("Name the suppliers of country "), "country", text(" with in_credit yes.")), F.col("gold"),
                               F.lit("supplier"), F.array(equal("country", F.col("country")), number("in_credit", "==", F.lit(1))), fit))
    over = p.withColumn("least", F.explode(F.array(*map(F.lit, (10, 20, 30, 40, 45, 48))))).where("size > least")
    out = out.unionByName(rows(members(over, "brand", "least"), "S3", "s3_size", F.concat_ws(" ", "brand", "least"), F.array(F.concat(F.lit("brand "), "brand")), (text("List the parts of "), "brand", text(" with size over "), F.col("least").cast("string"), text(".")), (text("Parts larger than "), F.col("least").cast("string"), text(" by "), "brand", text(", please.")), F.col("gold"),
                               F.lit("part"), F.array(equal("brand", F.col("brand")), number("size", ">", F.col("least"))), fit))
    return out.unionByName(rows(members(s, "country"), "S4", "s4_country", F.col("country"), F.array(F.concat(F.lit("country "), "country")), (text("Which suppliers belong to "), "country", text("?")), (text("All supplier pages below "), "country", text(".")), F.col("gold"),
                                F.lit("supplier"), F.array(equal("country", F.col("country"))), fit))


_CANDIDATES = f"""{wiki._FIELDS},
fs as (select path, max(vals[1]) filter (where field = 'country') as country, max(num) filter (where field = 'in_credit') = 1 as in_credit from fields where doc_type = 'supplier' group by path),
fp as (select path, max(vals[1]) filter (where field = 'brand') as brand, (max(num) filter (where field = 'size'))::bigint as size from fields where doc_type = 'part' group by path),
su as (select fs.*, title, parent from fs join docs using (path)), pa as (select fp.*, title from fp join docs using (path)),
cand as (
  select 's1_balance:' || path as cand, 'S1' as stratum, 's1_balance' as kind, ['supplier ' || path, 'country ' || country] as keys, true as usable, in_credit as priority, 'What is the balance of ' || title || '?' as text_t, 'Tell the account balance that ' || title || ' has.' as text_p, [path] as gold from su
  union all select 's2_region:' || path, 'S2', 's2_region', ['supplier ' || path, 'country ' || country], true, false, 'Which region is the country of ' || title || ' in?', 'In what region does ' || title || ' have its country?', [path, parent] from su
  union all select 's1_size:' || path, 'S1', 's1_size', ['part ' || path, 'brand ' || brand], true, false, 'What size is the ' || title || ' of ' || brand || '?', 'How large is ' || brand || ' ' || title || '?', [path] from pa
  union all select 's3_credit:' || country, 'S3', 's3_credit', ['country ' || country], count(*) between {SMALLEST} and {LARGEST}, false, 'Which suppliers in ' || country || ' are in credit?', 'Name the suppliers of country ' || country || ' with in_credit yes.', list(path) from su where in_credit group by country
  union all select 's3_size:' || brand || ' ' || least, 'S3', 's3_size', ['brand ' || brand], count(*) between {SMALLEST} and {LARGEST}, false, 'List the parts of ' || brand || ' with size over ' || least || '.', 'Parts larger than ' || least || ' by ' || brand || ', please.', list(path)
    from pa, (select unnest([10, 20, 30, 40, 45, 48]) as least) where size > least group by brand, least
  union all select 's4_country:' || country, 'S4', 's4_country', ['country ' || country], count(*) between {SMALLEST} and {LARGEST}, false, 'Which suppliers belong to ' || country || '?', 'All supplier pages below ' || country || '.', list(path) from su group by country)"""


def _seeded_sql(*values: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '7', {', '.join(values)})), 1, 15))::bigint"


def _rounds(n: int) -> str:
    """Minima over shared keys, n times; the wiki's components are stars, so three are enough."""
    ctes = ["ky as (select cand, unnest(keys) as key from cand)", "lb0 as (select distinct cand, cand as label from cand)"]
    for k in range(n):
        ctes.append(f"kl{k} as (select key, min(label) as label from ky join lb{k} using (cand) group by key)")
        ctes.append(f"lb{k + 1} as (select cand, min(label) as label from ky join kl{k} using (key) group by cand)")
    return ", ".join(ctes)


_QUESTIONS = f"""{_CANDIDATES}, {_rounds(4)},
pl as (select cand.*, case when {_seeded_sql("'set'", "label")} % 2 = 0 then 'dev' else 'heldout' end as set_ from cand join lb4 using (cand)),
ch as (select * from (select *, row_number() over (partition by kind, set_ order by priority desc, {_seeded_sql("kind", "cand")}, cand) as place from pl where usable) where place <= {EACH}),
qt as (select set_ || '-' || kind || '-' || place || '-' || suffix as query_id, set_, stratum, kind, suffix, case suffix when 't' then text_t else text_p end as text, gold, keys from ch, (select unnest(['t', 'p']) as suffix))"""


def _allocated(spark, sf_dir) -> DataFrame:
    """The chosen candidates, saved once for each table and session."""

    def save() -> str:
        question_sets.allocate(candidates(spark, sf_dir), EACH).write.parquet(path := shared_path(spark, "questions"))
        return path

    return spark.read.parquet(retrieval._once(spark, sf_dir, "questions", save))


def question_table(spark, sf_dir) -> DataFrame:
    return question_sets.worded(_allocated(spark, sf_dir))


@query
def question_allocation(spark, sf_dir):
    """The benchmark's questions, in two sets that share no fact, each in two wordings."""
    return question_table(spark, sf_dir).select("query_id", "set_", "stratum", "kind", "text", F.size("gold").cast("long").alias("n_gold"))


SQL["question_allocation"] = f"with {_QUESTIONS} select query_id, set_, stratum, kind, text, len(gold)::bigint as n_gold from qt"


@query
def question_leaks(spark, sf_dir):
    """For each set and kind, its questions, and how many of its facts the other set's questions tell: none."""
    chosen = _allocated(spark, sf_dir).withColumn("query_id", F.col("cand"))
    keys = chosen.select("query_id", F.explode("keys").alias("key"))
    shared = question_sets.leaks(chosen, keys).withColumn("leaks", F.lit(1))
    told = keys.join(shared, "key", "left").groupBy("query_id").agg(F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"))
    return chosen.join(told, "query_id").groupBy("set_", "kind").agg(F.count("*").alias("n"), F.sum("leaks").alias("n_leaks"))


SQL["question_leaks"] = f"""with {_QUESTIONS}, kk as (select cand, set_, kind, unnest(keys) as key from ch), sh as (select key, count(distinct set_) > 1 as leaks from kk group by key)
select set_, kind, count(distinct cand) as n, sum(leaks::int)::bigint as n_leaks from kk join sh using (key) group by all"""


ARMS = ("R2s", "R2", "R0", "R3s", "C_bm25", "C_flat_hybrid", "R6f", "R7f", "R7h")
#: The arms that the rules compare with R0.
FAMILY = ("R2s", "R3s", "R6f", "R7f", "R7h")


def _question_vectors(spark, sf_dir, questions: DataFrame) -> DataFrame:
    """A vector for each question: that of the number its id's digest names."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(vectors.agg(F.count("*").alias("n")))  # one row
    asked = questions.select("query_id", question_sets.seeded(7, F.lit("vector"), F.col("query_id")).alias("h")).join(n, how="cross")
    return asked.select("query_id", (F.col("h") % F.col("n")).alias("vec_id")).join(vectors, "vec_id").select("query_id", "embedding")


def benchmark_runs(spark, sf_dir) -> DataFrame:
    """arm, query_id, path and rank of every arm over all held-out questions, saved once for each table and session."""

    def save() -> str:
        chosen = _allocated(spark, sf_dir).where("set_ = 'heldout'")
        words = cut(question_sets.worded(chosen))
        docs, fields, edges = wiki.wiki_docs(spark, sf_dir), wiki.wiki_fields(spark, sf_dir).where("doc_type in ('supplier', 'part')"), wiki.wiki_edges(spark, sf_dir)
        told = chosen.select(F.concat_ws("-", "set_", "kind", "place").alias("base"), "doc_type", F.posexplode("conditions").alias("n", "c"))
        asked = words.select("query_id", F.regexp_replace("query_id", "-[tp]$", "").alias("base"))
        filters = asked.join(told, "base").select("query_id", "doc_type", F.col("n").cast("int").alias("n"), "c.field", "c.op", "c.s", "c.x")
        r0 = ranking.dense_docs(arms._vectors(spark, sf_dir, "flat"), _question_vectors(spark, sf_dir, words), "path", "unit_id")
        texts = docs.where("doc_type in ('supplier', 'part')").select(F.col("path").alias("unit_id"), "path", F.concat_ws(" ", "title", "description").alias("text"))
        run_arms(words.select("query_id", "text"), docs, fields, edges, filters, None, {"R0": r0}, texts=texts).write.parquet(path := shared_path(spark, "benchmark-runs"))
        return path

    return spark.read.parquet(retrieval._once(spark, sf_dir, "benchmark runs", save))


_FIELD_PART = len(wiki._FIELDS)
_HELD = "select query_id, text from qt where set_ = 'heldout'"
_asked = lambda sql: sql.replace(wiki.ASKED, _HELD)
_RUNS = f"""{_QUESTIONS}{_asked(arms._EVERY)[_FIELD_PART:]}, {wiki.EDGES}, {_asked(wiki.TITLES)},
qv as (select query_id, embedding::double[] as qe from qt join embeddings on vec_id = {_seeded_sql("'vector'", "query_id")} % (select count(*) from embeddings) where set_ = 'heldout'), {arms._R0[arms._R0.index("pg as"):]},
v1 as ({arms._EVERY_V1.replace(f"with {wiki._FIELDS}, f as", "with fv as").replace("join f using (path)", "join fv as f using (path)")}), {bm25_sql(arms._V1, _HELD, ident_sql, 50, '_v')}, r2 as (select query_id, unit_id as path, rank from ranked_v),
{bm25_sql(arms._BODY, _HELD, ident_sql, 50, '_c')}, c_bm25 as (select query_id, unit_id as path, rank from ranked_c),
{arms._expanded_sql('r3s', 'near')}, {arms._fused_sql('c_flat_hybrid', 60, 'r0', 'c_bm25')}, {arms._fused_sql('r7f', 30, 'r2s', 'r0')},
hits as (select query_id, unnest(gold) as path from qt where set_ = 'heldout' and stratum in ('S3', 'S4')),
r6f as ({arms._TIERS.format("select h.query_id, h.path, row_number() over (partition by h.query_id order by coalesce(score, 0) desc, h.path) as place from hits h left join r2s using (query_id, path) union all select query_id, path, 1000000 + rank from r2s", 50)}),
e3 as (select query_id, path, rank from tm where rank <= 3),
nb as (select distinct e3.query_id, n.dst as path from e3 join near n on n.src = e3.path where (e3.query_id, n.dst) not in (select query_id, path from e3)),
np as (select nb.query_id, nb.path, row_number() over (partition by nb.query_id order by coalesce(score, -1) desc, nb.path) as pos from nb left join r0 using (query_id, path)),
r7h as ({arms._TIERS.format("select query_id, path, rank as place from e3 union all select query_id, path, 1000000 + pos from np union all select query_id, path, 2000000 + rank from r7f", 50)}),
mx as ({" union all ".join(f"select '{name}' as arm, query_id, path, rank from {name.lower()}" for name in ARMS)})"""


@query
def benchmark_arms(spark, sf_dir):
    """For each arm and kind of held-out question: the questions that it answers, its ranked pages, and the gold ones among them."""
    runs = benchmark_runs(spark, sf_dir).withColumn("kind", F.regexp_extract("query_id", "^heldout-([^-]+)-", 1))
    gold = question_table(spark, sf_dir).select("query_id", F.explode("gold").alias("path")).withColumn("hit", F.lit(1))
    return runs.join(gold, ["query_id", "path"], "left").groupBy("arm", "kind").agg(F.count_distinct("query_id").alias("n_questions"), F.count("*").alias("n_ranked"), F.sum("rank").alias("rank_sum"), F.count("hit").alias("n_gold"))


SQL["benchmark_arms"] = f"""with {_RUNS}, gq as (select query_id, unnest(gold) as path, 1 as hit from qt)
select arm, split_part(mx.query_id, '-', 2) as kind, count(distinct mx.query_id) as n_questions, count(*) as n_ranked, sum(rank)::bigint as rank_sum, count(hit) as n_gold from mx left join gq on gq.query_id = mx.query_id and gq.path = mx.path group by 1, 2"""


def _metric_rows(spark, sf_dir) -> DataFrame:
    words = question_table(spark, sf_dir).where("set_ = 'heldout'")
    qrels = words.select("query_id", F.explode("gold").alias("doc"))
    found = evaluation.ir_metrics(benchmark_runs(spark, sf_dir).where(F.col("arm").isin("R0", *FAMILY)).withColumnRenamed("path", "doc"), qrels, "arm")
    told = words.select("query_id", "stratum", F.col("suffix").alias("set_"), F.when(F.col("kind") == "s3_size", "numeric").otherwise("").alias("condition"))
    return found.join(told, "query_id").withColumn("bundle", F.lit("standard"))


@query
def verdict_arms(spark, sf_dir):
    """The rules T1 to T5 over the arms' held-out questions, R0 being the base; cells without questions give no row."""
    return evaluation.verdict_rows(cut(benchmark_deltas(spark, sf_dir)))


_MEASURED = f"""{_RUNS},
both_ as (select query_id, path as doc, rank, arm as ranking from mx where arm in ('R0', {", ".join(f"'{a}'" for a in FAMILY)})),
gd as (select query_id, unnest(gold) as doc, 1 as rel from qt where set_ = 'heldout'), gc as (select query_id, count(*) as n from gd group by 1), {scoring._METRICS},
rw as (select 'standard' as bundle, arm, met.query_id, stratum, suffix as set_, case when kind = 's3_size' then 'numeric' else '' end as condition, ndcg10 from met join qt on qt.query_id = met.query_id), {scoring._CELLS},
{scoring._resampled_sql(scoring._DIFFERENCES.replace("'stem'", "'R0'"), 'cell, arm')}, cp as (select cell, arm, n, mean as delta, ci_low, ci_high, p from rs)"""
SQL["verdict_arms"] = f"with {_MEASURED}, {scoring._TESTED} " + scoring.SQL["verdict_v4"].split(scoring._TESTED, 1)[1]


@query
def benchmark_deltas(spark, sf_dir):
    """Each arm's mean difference to R0 in each cell of the held-out questions, with its interval and p."""
    pairs = evaluation.paired(cut(evaluation.cells(_metric_rows(spark, sf_dir))), "R0").withColumn("value", F.col("value") - F.col("base_value"))
    return evaluation.resampled(pairs, ["cell", "arm"]).withColumnRenamed("mean", "delta")


SQL["benchmark_deltas"] = f"with {_MEASURED} select * from cp"
