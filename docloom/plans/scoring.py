"""Evaluation queries: rankings of documents against contained benchmark items, and answers in conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, ranking
from ..operators.lineage import cut, shared_path
from .base import ident_sql, table
from .retrieval import _TWO, _once, _two_rankings, gold_containment
from .retrieval import SQL as _RETRIEVAL

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _runs(spark, sf_dir) -> DataFrame:
    return _two_rankings(spark, sf_dir).withColumnRenamed("ranking", "arm")


def _qrels(spark, sf_dir) -> DataFrame:
    """Which documents hold a question's text, saved once for each table and session."""

    def save() -> str:
        gold_containment(spark, sf_dir).select("query_id", F.col("doc_id").cast("string").alias("doc")).write.parquet(path := shared_path(spark, "qrels"))
        return path

    return spark.read.parquet(_once(spark, sf_dir, "qrels", save))


_METRICS = """met as (select arm, query_id, round(h1, 6) as p1, round(h10 / 10.0::double, 6) as p10, round(r10, 6) as r10, round(r50, 6) as r50, round(mrr, 6) as mrr10, round(ndcg, 6) as ndcg10,
    round(case when h10 / 10.0::double + r10 > 0 then 2 * (h10 / 10.0::double) * r10 / (h10 / 10.0::double + r10) else 0 end, 6) as f110 from (
  select arm, query_id, sum(rel) filter (rank <= 1)::double as h1, sum(rel) filter (rank <= 10)::double as h10,
    case when max(n) > 0 then sum(rel) filter (rank <= 10)::double / max(n) else 0 end as r10, case when max(n) > 0 then sum(rel) filter (rank <= 50)::double / max(n) else 0 end as r50,
    coalesce(1.0::double / min(rank) filter (rel = 1 and rank <= 10), 0) as mrr,
    case when max(n) > 0 then sum(rel / log2(rank + 1)) filter (rank <= 10) / list_sum(list_transform(range(1, 1 + least(max(n), 10)), lambda i: 1.0::double / log2(i + 1))) else 0 end as ndcg
  from (select b.ranking as arm, b.query_id, b.rank, coalesce(g.rel, 0) as rel, coalesce(c.n, 0) as n from both_ b left join gd g on g.query_id = b.query_id and g.doc = b.doc left join gc c on c.query_id = b.query_id) group by 1, 2))"""
_BASE = f"{_TWO}, gd as (select query_id, doc_id::varchar as doc, 1 as rel from ({_RETRIEVAL['gold_containment']})), gc as (select query_id, count(*) as n from gd group by 1), {_METRICS}"


@query
def ir_metrics(spark, sf_dir):
    return evaluation.ir_metrics(_runs(spark, sf_dir), _qrels(spark, sf_dir), "arm")


SQL["ir_metrics"] = f"with {_BASE} select * from met"


def _metric_rows(spark, sf_dir) -> DataFrame:
    q = F.col("query_id")
    rows = ir_metrics(spark, sf_dir).withColumns({
        "bundle": F.when(q % 5 == 0, "noparent").otherwise("standard"), "stratum": F.concat(F.lit("S"), (q % 4 + 1).cast("string")),
        "set_": F.when(q % 3 == 0, "p").otherwise("t"), "condition": F.when(q % 2 == 0, "numeric").otherwise(""),
    })
    return rows.select("bundle", "arm", "query_id", "stratum", "set_", "condition", *evaluation.METRICS)


_ROWS = "rw as (select case when query_id % 5 = 0 then 'noparent' else 'standard' end as bundle, arm, query_id, 'S' || (query_id % 4 + 1) as stratum, case when query_id % 3 = 0 then 'p' else 't' end as set_, case when query_id % 2 = 0 then 'numeric' else '' end as condition, p1, p10, r10, r50, mrr10, ndcg10, f110 from met)"


@query
def metric_rows(spark, sf_dir):
    return _metric_rows(spark, sf_dir)


SQL["metric_rows"] = f"with {_BASE}, {_ROWS} select * from rw"


@query
def stratum_policy_metrics(spark, sf_dir):
    runs = _runs(spark, sf_dir).where("arm = 'ident'").drop("arm")
    strata = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("s"), (F.col("item_id") % 5 + 1).cast("string")).alias("stratum"))
    return evaluation.stratum_metrics(runs, _qrels(spark, sf_dir), strata)


_CUTS = " union all ".join(f"select '{s}' as stratum, {k} as k" for s, ks in evaluation.STRATUM_CUTS.items() for k in ks)
SQL["stratum_policy_metrics"] = f"""with {_BASE}, j as (select b.query_id, 's' || (b.query_id % 5 + 1) as stratum, b.rank, coalesce(g.rel, 0) as rel, coalesce(c.n, 0) as n from both_ b left join gd g on g.query_id = b.query_id and g.doc = b.doc left join gc c on c.query_id = b.query_id where ranking = 'ident'),
ct as ({_CUTS}),
m as (select query_id, stratum, k, coalesce(sum(rel) filter (rank <= k), 0)::double as h, max(n) as n, coalesce(sum(rel / log2(rank + 1)) filter (rank <= k), 0) as g from j join ct using (stratum) group by all)
select query_id, stratum, 'p' || k as metric, round(h / k, 6) as value from m union all select query_id, stratum, 'r' || k, round(case when n > 0 then h / n else 0 end, 6) from m
union all select query_id, stratum, 'ndcg' || k, round(case when n > 0 then g / list_sum(list_transform(range(1, 1 + least(n, k)), lambda i: 1.0::double / log2(i + 1))) else 0 end, 6) from m
union all select query_id, stratum, 'mrr10', round(coalesce(1.0::double / min(rank) filter (rel = 1 and rank <= 10), 0), 6) from j where stratum <> 's5' group by query_id, stratum"""


@query
def cells(spark, sf_dir):
    return evaluation.cells(_metric_rows(spark, sf_dir))


_CELLS = """cl as (select c.cell, arm, query_id, ndcg10 from rw, lateral (select unnest(list_filter([
  case when bundle = 'noparent' and set_ = 't' and stratum = 'S4' then 'S4_np_t' end, case when bundle <> 'noparent' and set_ = 't' then 'S1to4_t' end,
  case when bundle <> 'noparent' and set_ = 't' and stratum in ('S3', 'S4') then 'S34_t' end, case when bundle <> 'noparent' and set_ = 't' and stratum = 'S3' and condition = 'numeric' then 'S3num_t' end,
  case when bundle <> 'noparent' and set_ = 't' and stratum = 'S2' then 'S2_t' end, case when bundle <> 'noparent' and set_ = 't' and stratum = 'S1' then 'S1_t' end,
  case when bundle <> 'noparent' and set_ = 'p' and stratum in ('S3', 'S4') then 'S34_p' end], lambda x: x is not null)) as cell) c)"""
SQL["cells"] = f"with {_BASE}, {_ROWS}, {_CELLS} select * from cl"


@query
def metric_summary(spark, sf_dir):
    return evaluation.summary(_metric_rows(spark, sf_dir))


SQL["metric_summary"] = f"with {_BASE}, {_ROWS}, x as (select * from rw union all select * replace ('S3num' as stratum) from rw where stratum = 'S3' and condition = 'numeric') select bundle, arm, stratum, set_, count(*) as n, {', '.join(f'round(avg({m}), 6) as {m}_mean' for m in evaluation.METRICS)} from x group by all"


@query
def paired_delta(spark, sf_dir):
    pairs = evaluation.paired(cells(spark, sf_dir), "stem")
    return pairs.groupBy("cell", "arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("base_value")), 6).alias("delta"))


SQL["paired_delta"] = f"with {_BASE}, {_ROWS}, {_CELLS} select a.cell, a.arm, count(*) as n, round(avg(a.ndcg10 - b.ndcg10), 6) as delta from cl a join cl b on a.cell = b.cell and a.query_id = b.query_id and a.arm <> 'stem' and b.arm = 'stem' group by all"


def _paired_differences(spark, sf_dir) -> DataFrame:
    return evaluation.paired(cut(cells(spark, sf_dir)), "stem").withColumn("value", F.col("value") - F.col("base_value"))


def _compared(spark, sf_dir) -> DataFrame:
    return evaluation.resampled(_paired_differences(spark, sf_dir), ["cell", "arm"]).withColumnRenamed("mean", "delta")


@query
def bootstrap_paired(spark, sf_dir):
    """Each arm's mean difference to the base in each cell, with its interval and p, by counted draws."""
    return _compared(spark, sf_dir)


@query
def bootstrap_mean(spark, sf_dir):
    return evaluation.resampled(_metric_rows(spark, sf_dir).withColumn("value", F.col("ndcg10")), ["arm"])


@query
def bootstrap_paired_numpy(spark, sf_dir):
    """As the reference draws: numpy's generator over each cell's queries in order."""
    return evaluation.bootstrap_paired(evaluation.paired(cells(spark, sf_dir), "stem"))


@query
def bootstrap_mean_numpy(spark, sf_dir):
    return evaluation.bootstrap_mean(_metric_rows(spark, sf_dir), "arm", "ndcg10")


def _resampled_sql(values: str, by: str, tag: str = "") -> str:
    """CTEs ending in rs, as evaluation.resampled; values is a query of the keys, query_id and v in millionths."""
    weight = lambda j: " + ".join(f"(('0x' || substr(h, {1 + 8 * j}, 8))::bigint >= {t})::bigint" for t in evaluation.poisson_steps())
    draws = " union all ".join(f"select {by}, i, {j} as j, sum(w{j} * v)::bigint as s, sum(w{j})::bigint as n from wt{tag} group by {by}, i" for j in range(4))
    return f"""vl{tag} as ({values}),
hs{tag} as (select {by}, v, i, md5('{evaluation.SEED}|' || i || '|' || query_id) as h from vl{tag}, range({evaluation.BOOTSTRAPS // 4}) as r(i)),
wt{tag} as (select {by}, v, i, {", ".join(f"{weight(j)} as w{j}" for j in range(4))} from hs{tag}),
dw{tag} as ({draws}),
mn{tag} as (select {by}, s::double / n / 1000000.0::double as m from dw{tag} where n > 0),
sp{tag} as (select {by}, round(quantile_cont(m, 0.025), 6) as ci_low, round(quantile_cont(m, 0.975), 6) as ci_high,
  round(least(1.0::double, 2 * least((count(*) filter (where m <= 0))::double / count(*), (count(*) filter (where m >= 0))::double / count(*))), 6) as p from mn{tag} group by {by}),
tl{tag} as (select {by}, count(*) as n, round(sum(v)::double / count(*) / 1000000.0::double, 6) as mean from vl{tag} group by {by}),
rs{tag} as (select * from tl{tag} join sp{tag} using ({by}))"""


_DIFFERENCES = "select a.cell, a.arm, a.query_id, round((a.ndcg10 - b.ndcg10) * 1000000)::bigint as v from cl a join cl b on a.cell = b.cell and a.query_id = b.query_id and a.arm <> 'stem' and b.arm = 'stem'"
_COMPARED = f"{_BASE}, {_ROWS}, {_CELLS}, {_resampled_sql(_DIFFERENCES, 'cell, arm')}, cp as (select cell, arm, n, mean as delta, ci_low, ci_high, p from rs)"
SQL["bootstrap_paired"] = f"with {_COMPARED} select * from cp"
SQL["bootstrap_mean"] = f"with {_BASE}, {_ROWS}, {_resampled_sql('select arm, query_id, round(ndcg10 * 1000000)::bigint as v from rw', 'arm')} select arm, n, mean, ci_low, ci_high, p from rs"


@query
def verdict_v4(spark, sf_dir):
    return evaluation.verdict_rows(cut(_compared(spark, sf_dir)))


@query
def verdict_pilot(spark, sf_dir):
    return evaluation.verdict_pilot(cut(_compared(spark, sf_dir)))


#: Holm's correction within each cell, and the comparisons side by side.
_TESTED = """hm as (select *, row_number() over (partition by cell order by p, arm) - 1 as i, count(*) over (partition by cell) as m from cp),
sg as (select *, bool_and(p <= 0.05::double / (m - i)) over (partition by cell order by p, arm rows between unbounded preceding and current row) as significant from hm),
main as (select a.arm, a.delta, a.ci_low, a.significant, p.delta as dp, p.ci_low as lp, s.ci_low as ls from sg a left join cp p on p.arm = a.arm and p.cell = 'S34_p' left join cp s on s.arm = a.arm and s.cell = 'S2_t' where a.cell = 'S34_t')"""
SQL["verdict_v4"] = f"""with {_COMPARED}, {_TESTED}
select 'T1' as rule, arm, coalesce(ci_low > 0 and significant and delta > 0 and lp > 0 and dp >= 0.5::double * delta, false) as pass from main
union all select 'T4', arm, coalesce(ci_low > 0 and significant and ls > -0.05::double, false) from main
union all select 'T5', arm, ci_low > 0 from main
union all select case cell when 'S4_np_t' then 'T2' else 'T3' end, arm, ci_low > 0 and significant from sg where cell in ('S4_np_t', 'S3num_t')"""
SQL["verdict_pilot"] = f"""with {_COMPARED}, {_TESTED}, c2 as (select *, delta > 0 and ci_low > 0 and significant as pass from main)
select 'C1' as criterion, arm, ci_low > -0.05::double as pass from cp where cell = 'S1_t'
union all select 'C2', arm, pass from c2
union all select 'C3', arm, coalesce(pass and lp > 0 and dp >= 0.5::double * delta, false) from c2"""


@query
def holm(spark, sf_dir):
    """Holm's correction over p-values read off events: the share of values under 1 for each user, by event type."""
    events = table(spark, sf_dir, "events")
    tests = events.groupBy("event_type", F.col("user_id").cast("string").alias("name")).agg(F.round(F.avg((F.col("value") < 1).cast("double")) / 10, 9).alias("p"))
    return evaluation.holm(tests, "event_type")


SQL["holm"] = """with t as (select event_type, user_id::varchar as name, round(avg((value < 1)::int::double) / 10, 9) as p from events group by all),
r as (select *, row_number() over (partition by event_type order by p, name) - 1 as i, count(*) over (partition by event_type) as m from t)
select event_type, name, p, bool_and(p <= 0.05::double / (m - i)) over (partition by event_type order by p, name rows between unbounded preceding and current row) as significant from r"""


@query
def rrf_tune(spark, sf_dir):
    """Mean nDCG@10 of each fusion constant, and which is best: the larger of equal ones."""
    runs = _two_rankings(spark, sf_dir)
    grid = spark.createDataFrame([(k,) for k in (1, 3, 10, 30, 60)], "rrf_k int")
    each = runs.join(F.broadcast(grid))  # five rows
    first = each.groupBy("rrf_k", "query_id", "ranking", "doc").agg(F.min("rank").alias("rank"))
    scored = first.groupBy("rrf_k", "query_id", "doc").agg(F.round(F.sum(1.0 / (F.col("rrf_k") + F.col("rank"))), 9).alias("score"))
    fused = ranking.top(scored, 10, F.col("score").desc(), F.col("doc"), by=("rrf_k", "query_id"))
    means = evaluation.ir_metrics(fused, _qrels(spark, sf_dir), "rrf_k").groupBy("rrf_k").agg(F.round(F.avg("ndcg10"), 6).alias("mean_ndcg10"))
    from pyspark.sql import Window

    order = Window.orderBy(F.col("mean_ndcg10").desc(), F.col("rrf_k").desc())
    return means.withColumn("best", F.row_number().over(order) == 1)


SQL["rrf_tune"] = f"""with {_BASE}, gr as (select unnest([1, 3, 10, 30, 60])::int as rrf_k),
fs as (select rrf_k, query_id, doc, round(sum(1.0::double / (rrf_k + rank)), 9) as score from both_, gr group by all),
fr as (select *, row_number() over (partition by rrf_k, query_id order by score desc, doc) as rank from fs),
nd as (select f.rrf_k, f.query_id, round(case when max(coalesce(c.n, 0)) > 0 then sum(coalesce(g.rel, 0) / log2(rank + 1)) / list_sum(list_transform(range(1, 1 + least(max(coalesce(c.n, 0)), 10)), lambda i: 1.0::double / log2(i + 1))) else 0 end, 6) as v
  from fr f left join gd g on g.query_id = f.query_id and g.doc = f.doc left join gc c on c.query_id = f.query_id where rank <= 10 group by 1, 2),
mn as (select rrf_k, round(avg(v), 6) as mean_ndcg10 from nd group by 1)
select *, row_number() over (order by mean_ndcg10 desc, rrf_k desc) = 1 as best from mn"""


@query
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


SQL["latency_percentiles"] = "select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1"


@query
def answer_norm(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.answer_norm(F.concat("text", F.lit(" 1,234 and 5,6 of 12 percent – done"))).cast("binary")).alias("norm_md5"))


SQL["answer_norm"] = r"select conv_id, turn, md5(trim(regexp_replace(regexp_replace(replace(lower(text || ' 1234 and 5,6 of 12 percent – done'), '–', '-'), '[\t\n\v\f\r ]*percent\b', '%', 'g'), '[\t\n\v\f\r ]+', ' ', 'g'), ' ')) as norm_md5 from conversations"


@query
def abstention(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Not found: "), F.col("text"))).when(F.col("turn") % 3 == 1, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.abstained(text).alias("abstained"))


SQL["abstention"] = """with a as (select conv_id, turn, case turn % 3 when 0 then 'Not found: ' || text when 1 then text end as answer from conversations)
select conv_id, turn, answer is null or contains(upper(answer), 'NOT FOUND') as abstained from a"""


@query
def claim_sentences(spark, sf_dir):
    claims = T.claim_sentences(F.concat(F.col("text"), F.lit(" Done [1]. So it is [23]!")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(claims).cast("long").alias("n_claims"), F.md5(F.array_join(claims, "\n").cast("binary")).alias("claims_md5"))


SQL["claim_sentences"] = r"""with s as (select conv_id, turn, trim(regexp_replace(regexp_replace(text || ' Done [1]. So it is [23]!', '[\t\n\v\f\r ]*\[[0-9]+\]', '', 'g'), '[\t\n\v\f\r ]+', ' ', 'g'), ' ') as t from conversations),
p as (select conv_id, turn, list_filter(string_split(regexp_replace(t, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as c from s)
select conv_id, turn, len(c)::bigint as n_claims, md5(array_to_string(c, chr(10))) as claims_md5 from p"""


def _supported(spark, sf_dir) -> DataFrame:
    """Claims of assistant turns with a support: the share of the claim's words that the turn before it has (a scorer's stand-in)."""
    rows = table(spark, sf_dir, "conversations")
    own = rows.where("role = 'assistant'").select("conv_id", "turn", F.explode(T.claim_sentences(F.col("text"))).alias("claim"))
    asked = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), T.tokenize_ident(F.col("text")).alias("had"))
    words = T.tokenize_ident(F.col("claim"))
    share = F.size(F.array_intersect(words, "had")) / F.greatest(F.size(F.array_distinct(words)), F.lit(1))
    return own.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", F.round(share, 6).alias("support"))


@query
def claim_min(spark, sf_dir):
    return _supported(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min("support").alias("support"))


SQL["claim_min"] = rf"""with s as (select conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\t\n\v\f\r ]*\[[0-9]+\]', '', 'g'), '[\t\n\v\f\r ]+', ' ', 'g'), ' ') as t from conversations where role = 'assistant'),
c as (select conv_id, turn, unnest(list_filter(string_split(regexp_replace(t, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) as text from s),
h as (select conv_id, turn + 1 as turn, {ident_sql('text')} as had from conversations),
w as (select conv_id, turn, list_distinct({ident_sql('text')}) as ws from c)
select conv_id, turn, min(round(len(list_filter(ws, lambda x: list_contains(had, x)))::double / greatest(len(ws), 1), 6)) as support from w join h using (conv_id, turn) group by all"""


@query
def fact_correct(spark, sf_dir):
    """Whether a part's description states its brand, size and price."""
    p = table(spark, sf_dir, "part")
    answer = F.when(F.col("p_partkey") % 10 == 0, "NOT FOUND").otherwise(F.format_string("%s costs $%s and measures %d square feet.", "p_name", F.format_number("p_retailprice", 2), F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)))
    reference = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).otherwise(F.format_string("%d square feet", "p_size"))
    return p.select("p_partkey", T.fact_correct(answer, reference).alias("correct"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '–', '-'), '(\d),(\d\d\d)\b', '\1\2', 'g'), '\s*percent\b', '%', 'g'), '\s+', ' ', 'g'))"
SQL["fact_correct"] = rf"""with a as (select p_partkey, case when p_partkey % 10 = 0 then 'NOT FOUND' else p_name || ' costs $' || format('{{:,.2f}}', p_retailprice) || ' and measures ' || (p_size + case when p_partkey % 7 = 0 then 1 else 0 end) || ' square feet.' end as answer,
  case when p_partkey % 2 = 0 then '$' || format('{{:,.2f}}', p_retailprice) else p_size || ' square feet' end as reference from part),
c as (select p_partkey, answer, {_PLAIN.format('answer')} as said, regexp_replace(regexp_replace(regexp_replace({_PLAIN.format('reference')}, ' (square feet|days|day|cents|cent|hours|hour)$', ''), '^\$+', ''), '%+$', '') as core from a)
select p_partkey, (not contains(upper(answer), 'NOT FOUND') and regexp_matches(said, '(^|[^\w.])' || regexp_escape(core) || '($|\W)'))::int::double as correct from c"""


@query
def set_f1(spark, sf_dir):
    """Suppliers named in answers, some missing and some wrong, against those of a nation."""
    s = table(spark, sf_dir, "supplier")
    aliases = s.select("s_name", "s_name").toDF("alias", "name").unionByName(s.select(F.regexp_replace("s_name", "^Supplier#", "vendor "), "s_name").toDF("alias", "name"))
    gold = s.select(F.col("s_nationkey").alias("query_id"), F.col("s_name").alias("name"))
    named = F.when(F.col("s_suppkey") % 3 == 0, F.regexp_replace("s_name", "^Supplier#", "Vendor ")).when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))
    answers = s.groupBy(F.col("s_nationkey").alias("query_id")).agg(F.concat_ws("; ", F.lit("They are"), F.array_sort(F.collect_list(named)), F.lit("Supplier#000000001")).alias("answer"))
    return evaluation.set_f1(answers, aliases, gold)


SQL["set_f1"] = """with n as (select s_nationkey as query_id, s_name, s_suppkey % 3 < 2 as named from supplier),
g as (select query_id, count(*)::double as n_gold, count(*) filter (named)::double as hit, bool_or(s_name = 'Supplier#000000001') as own from n group by 1),
x as (select query_id, n_gold, hit, hit + case when own then 0 else 1 end as got from g)
select query_id, round(case when hit > 0 then 2 * (hit / got) * (hit / n_gold) / (hit / got + hit / n_gold) else 0 end, 6) as f1 from x"""


@query
def cohen_kappa(spark, sf_dir):
    return evaluation.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


SQL["cohen_kappa"] = """with l as (select quality as a, 1 - toxic as b from labels), n as (select count(*)::double as n, avg((a = b)::int::double) as po from l),
e as (select sum(ka * kb) as s from (select a as x, count(*)::double as ka from l group by 1) join (select b as x, count(*)::double as kb from l group by 1) using (x))
select n::bigint as n, round(po, 6) as agreement, round(case when s / (n * n) = 1 then 1 else (po - s / (n * n)) / (1 - s / (n * n)) end, 6) as kappa from n, e"""


@query
def answer_verdict(spark, sf_dir):
    """Mean faithfulness and context tokens of even and odd conversations, and the mean difference of paired turns."""
    scored = claim_min(spark, sf_dir).withColumn("faithful", T.faithful(F.col("support"), F.lit("an answer"), 0.1))
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.whitespace_tokens(F.col("text"))).alias("tokens"))
    rows = scored.join(tokens, ["conv_id", "turn"]).withColumn("arm", F.when(F.col("conv_id") % 2 == 0, "R0").otherwise("R2s"))
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("faithful"), 6).alias("faithful"), F.round(F.avg("tokens"), 6).alias("tokens"))


SQL["answer_verdict"] = rf"""with m as ({SQL['claim_min']}), t as (select conv_id, turn, len(regexp_extract_all(text, '[^\t\n\v\f\r ]+')) as tokens from conversations)
select case when conv_id % 2 = 0 then 'R0' else 'R2s' end as arm, count(*) as n, round(avg((support >= 0.1::double)::int::double), 6) as faithful, round(avg(tokens), 6) as tokens from m join t using (conv_id, turn) group by 1"""


@query
def stratified_sample(spark, sf_dir):
    return evaluation.stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")


SQL["stratified_sample"] = "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5('7:' || doc_id), doc_id) as r from documents) where r <= 8"
