"""Scoring rankings and answers: rank metrics, cells, bootstrap comparisons, Holm correction, verdicts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import let
from ..functions.text import answer_norm, has_token

METRICS = ("p1", "p10", "r10", "r50", "mrr10", "ndcg10", "f110")
#: Fixed values of the preregistered rules.
BOOTSTRAPS, SEED, ALPHA, PARAPHRASE_RATIO, MARGIN = 10_000, 7, 0.05, 0.5, -0.05
#: Cut-offs scored for each stratum; s5 has no rank metrics.
STRATUM_CUTS = {"s1": (1, 5, 10), "s2": (1, 5, 10), "s3": (5, 10, 20), "s4": (20, 50), "mined": (1, 5, 10)}


def _judged(runs: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """Each run's ranking without repetitions, ranks closed up, with rel and the number of gold documents."""
    gold = qrels.select("query_id", "doc").distinct()
    first = runs.groupBy(*by, "query_id", "doc").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("rank"))
    counts = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    ranked = first.withColumn("rank", place).join(gold.withColumn("_rel", F.lit(1)), ["query_id", "doc"], "left").withColumn("rel", F.coalesce("_rel", F.lit(0)))
    return ranked.join(counts, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))


def _hits(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))


def _ndcg(k: int) -> Column:
    gain = F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    n = F.least(F.max("n_gold"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return F.when(F.max("n_gold") > 0, gain / ideal).otherwise(0.0)


def _recall(k: int) -> Column:
    return F.when(F.max("n_gold") > 0, _hits(k) / F.max("n_gold")).otherwise(0.0)


def ir_metrics(runs: DataFrame, qrels: DataFrame, *by: str) -> DataFrame:
    """The seven metrics of each run and query of runs (by..., query_id, rank, doc) against qrels (query_id, doc)."""
    reciprocal = F.coalesce(1.0 / F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0))
    out = _judged(runs, qrels, list(by)).groupBy(*by, "query_id").agg((_hits(1) / 1.0).alias("p1"), (_hits(10) / 10.0).alias("p10"), _recall(10).alias("r10"), _recall(50).alias("r50"), reciprocal.alias("mrr10"), _ndcg(10).alias("ndcg10"))
    both = F.col("p10") + F.col("r10")
    out = out.withColumn("f110", F.when(both > 0, 2 * F.col("p10") * F.col("r10") / both).otherwise(0.0))
    return out.select(*by, "query_id", *[F.round(m, 6).alias(m) for m in METRICS])


def stratum_metrics(runs: DataFrame, qrels: DataFrame, strata: DataFrame) -> DataFrame:
    """query_id, stratum, metric and value under each stratum's cut-offs (strata: query_id, stratum)."""
    cuts = [k for k in (1, 5, 10, 20, 50)]
    judged = _judged(runs, qrels, []).join(strata, "query_id")
    reciprocal = F.coalesce(1.0 / F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0))
    wide = judged.groupBy("query_id", "stratum").agg(*[x for k in cuts for x in ((_hits(k) / float(k)).alias(f"p{k}"), _recall(k).alias(f"r{k}"), _ndcg(k).alias(f"ndcg{k}"))], reciprocal.alias("mrr10"))
    long = wide.unpivot(["query_id", "stratum"], [*(f"{m}{k}" for k in cuts for m in ("p", "r", "ndcg")), "mrr10"], "metric", "value")
    wanted = [(s, f"{m}{k}") for s, ks in STRATUM_CUTS.items() for k in ks for m in ("p", "r", "ndcg")] + [(s, "mrr10") for s in STRATUM_CUTS]
    allowed = runs.sparkSession.createDataFrame(wanted, "stratum string, metric string")
    return long.join(F.broadcast(allowed), ["stratum", "metric"]).select("query_id", "stratum", "metric", F.round("value", 6).alias("value"))  # a fixed table


def cells(rows: DataFrame) -> DataFrame:
    """cell, arm, query_id and ndcg10 of metric rows (bundle, arm, query_id, stratum, set_, condition, ndcg10), each in every cell it belongs to."""
    main, t = F.col("bundle") != "noparent", F.col("set_") == "t"
    tests = {
        "S4_np_t": ~main & t & (F.col("stratum") == "S4"),
        "S1to4_t": main & t,
        "S34_t": main & t & F.col("stratum").isin("S3", "S4"),
        "S3num_t": main & t & (F.col("stratum") == "S3") & (F.col("condition") == "numeric"),
        "S2_t": main & t & (F.col("stratum") == "S2"),
        "S1_t": main & t & (F.col("stratum") == "S1"),
        "S34_p": main & ~t & F.col("stratum").isin("S3", "S4"),
    }
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return rows.select(F.explode(names).alias("cell"), "arm", "query_id", "ndcg10")


def summary(rows: DataFrame) -> DataFrame:
    """Means of the metrics by bundle, arm, stratum and set; numeric S3 rows count in S3num too."""
    numeric = rows.where("stratum = 'S3' and condition = 'numeric'").withColumn("stratum", F.lit("S3num"))
    means = [F.round(F.avg(m), 6).alias(f"{m}_mean") for m in METRICS]
    return rows.unionByName(numeric).groupBy("bundle", "arm", "stratum", "set_").agg(F.count("*").alias("n"), *means)


def paired(cell_rows: DataFrame, base: str) -> DataFrame:
    """cell, arm, query_id and both values of each arm and the base arm, on the queries both have."""
    own = cell_rows.where(F.col("arm") == base).select("cell", "query_id", F.col("ndcg10").alias("base_value"))
    return cell_rows.where(F.col("arm") != base).join(own, ["cell", "query_id"]).select("cell", "arm", "query_id", F.col("ndcg10").alias("value"), "base_value")


def bootstrap(differences: np.ndarray, n_boot: int = BOOTSTRAPS, seed: int = SEED) -> tuple[float, float, float, float]:
    """Mean, 2.5 and 97.5 percentiles of resampled means, and the two-sided p; in blocks, so memory does not follow n * n_boot."""
    n = len(differences)
    rng, means, step = np.random.default_rng(seed), [], max(1, 4_000_000 // max(n, 1))
    for at in range(0, n_boot, step):
        means.append(differences[rng.integers(0, n, (min(step, n_boot - at), n))].mean(axis=1))
    b = np.concatenate(means)
    low, high = np.percentile(b, [2.5, 97.5])
    return float(differences.mean()), float(low), float(high), float(min(1.0, 2 * min((b <= 0).mean(), (b >= 0).mean())))


def bootstrap_paired(pairs: DataFrame, n_boot: int = BOOTSTRAPS, seed: int = SEED) -> DataFrame:
    """cell, arm, n, delta, ci_low, ci_high and p of value - base_value, queries in id order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("query_id")
        d = (frame["value"] - frame["base_value"]).to_numpy()
        return pd.DataFrame([(frame["cell"].iloc[0], frame["arm"].iloc[0], len(d), *bootstrap(d, n_boot, seed))], columns=["cell", "arm", "n", "delta", "ci_low", "ci_high", "p"])

    return pairs.groupBy("cell", "arm").applyInPandas(run, "cell string, arm string, n long, delta double, ci_low double, ci_high double, p double")


def bootstrap_mean(rows: DataFrame, key: str, value: str, n_boot: int = BOOTSTRAPS, seed: int = SEED) -> DataFrame:
    """key, n, mean and its confidence interval."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        d = frame.sort_values("query_id")[value].to_numpy(float)
        mean, low, high, _ = bootstrap(d, n_boot, seed)
        return pd.DataFrame([(frame[key].iloc[0], len(d), mean, low, high)], columns=[key, "n", "mean", "ci_low", "ci_high"])

    return rows.groupBy(key).applyInPandas(run, f"{key} string, n long, mean double, ci_low double, ci_high double")


def poisson_steps(most: int = 12) -> list[int]:
    """The values, of 32-bit numbers, from which on a Poisson weight of mean 1 is 1, 2, 3 and so on; weights over `most` have no such number."""
    total, steps = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        steps.append(int(total * 2**32))
    return steps


def resampled(rows: DataFrame, by: list[str], n_boot: int = BOOTSTRAPS, seed: int = SEED) -> DataFrame:
    """by, n, mean, ci_low, ci_high and p (two-sided, of the mean being 0) of value over rows (by, query_id, value), all rounded to six decimals.

    Bootstrap by counters: in draw d a row counts as often as the Poisson quantile of a hash of the seed, d and its query
    says. So draws are sums that combine map-side, whatever the size of a group, no group is one task's, a query has one
    weight a draw in all groups, and any engine computes the same numbers. Values are taken in millionths, so sums are exact.
    One digest serves four draws. Draws without any row are left out.
    """
    if n_boot % 4:
        raise ValueError("draws come in fours")
    values = rows.select(*by, F.col("query_id").cast("string").alias("_q"), F.round(F.col("value") * 1_000_000).cast("long").alias("_v"))
    told = values.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("_v") / F.count("*") / 1_000_000.0, 6).alias("mean"))
    each = values.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_boot // 4 - 1))))
    each = each.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_i").cast("string"), F.col("_q")).cast("binary")))
    drawn = [F.conv(F.substring("_h", 1 + 8 * j, 8), 16, 10).cast("long").alias(f"_u{j}") for j in range(4)]
    weights = [sum(((F.col(f"_u{j}") >= t).cast("long") for t in poisson_steps()), F.lit(0)).alias(f"_w{j}") for j in range(4)]
    each = each.select(*by, "_i", "_v", *drawn).select(*by, "_i", "_v", *weights)
    sums = each.groupBy(*by, "_i").agg(*[F.sum(F.col(f"_w{j}") * F.col("_v")).alias(f"_s{j}") for j in range(4)], *[F.sum(f"_w{j}").alias(f"_n{j}") for j in range(4)])
    draws = sums.select(*by, F.explode(F.array(*[F.struct(F.col(f"_s{j}").alias("s"), F.col(f"_n{j}").alias("n")) for j in range(4)])).alias("x")).where("x.n > 0")
    draws = draws.select(*by, (F.col("x.s") / F.col("x.n") / 1_000_000.0).alias("m"))
    share = lambda test: F.count_if(test) / F.count("*")
    spread = draws.groupBy(*by).agg(
        F.round(F.percentile("m", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("ci_high"),
        F.round(F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0))), 6).alias("p"),
    )
    return told.join(spread, by)


def holm(tests: DataFrame, *family: str, alpha: float = ALPHA) -> DataFrame:
    """tests (family..., name, p) with significant: by rising p, p <= alpha / (m - i) until the first that fails; ties by name."""
    order = Window.partitionBy(*family).orderBy("p", "name")
    ranked = tests.withColumn("_i", F.row_number().over(order) - 1).withColumn("_m", F.count("*").over(Window.partitionBy(*family)))
    ok = F.col("p") <= alpha / (F.col("_m") - F.col("_i"))
    return ranked.withColumn("significant", F.every(ok).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m")


def verdict_rows(compared: DataFrame) -> DataFrame:
    """rule, arm and pass of the rules T1 to T5 over compared (cell, arm, delta, ci_low, p; base R0)."""
    main = holm(compared.where("cell = 'S34_t'").withColumnRenamed("arm", "name"), "cell").select(F.col("name").alias("arm"), "delta", "ci_low", "significant")
    side = lambda cell, *cols: compared.where(F.col("cell") == cell).select("arm", *[F.col(c).alias(f"{c}_{cell}") for c in cols])
    wide = main.join(side("S34_p", "delta", "ci_low"), "arm", "left").join(side("S2_t", "ci_low"), "arm", "left")
    sound = (F.col("ci_low") > 0) & F.col("significant")
    rules = F.array(
        F.struct(F.lit("T1").alias("rule"), (sound & (F.col("delta") > 0) & (F.col("ci_low_S34_p") > 0) & (F.col("delta_S34_p") >= PARAPHRASE_RATIO * F.col("delta"))).alias("pass")),
        F.struct(F.lit("T4").alias("rule"), (sound & (F.col("ci_low_S2_t") > MARGIN)).alias("pass")),
        F.struct(F.lit("T5").alias("rule"), (F.col("ci_low") > 0).alias("pass")),
    )
    out = wide.select("arm", F.explode(rules).alias("x")).select("x.rule", "arm", F.coalesce("x.pass", F.lit(False)).alias("pass"))
    for rule, cell in (("T2", "S4_np_t"), ("T3", "S3num_t")):
        own = holm(compared.where(F.col("cell") == cell).withColumnRenamed("arm", "name"), "cell")
        out = out.unionByName(own.select(F.lit(rule).alias("rule"), F.col("name").alias("arm"), ((F.col("ci_low") > 0) & F.col("significant")).alias("pass")))
    return out


def verdict_pilot(compared: DataFrame, margin: float = -0.05) -> DataFrame:
    """criterion, arm and pass of C1 to C3 over compared: C1 no arm much worse on S1, C2 some arm better on S3 and S4, C3 and on their paraphrases."""
    c1 = compared.where("cell = 'S1_t'").select(F.lit("C1").alias("criterion"), "arm", (F.col("ci_low") > margin).alias("pass"))
    c2 = holm(compared.where("cell = 'S34_t'").withColumnRenamed("arm", "name"), "cell").select(F.col("name").alias("arm"), "delta", ((F.col("delta") > 0) & (F.col("ci_low") > 0) & F.col("significant")).alias("pass"))
    p = compared.where("cell = 'S34_p'").select("arm", F.col("delta").alias("dp"), F.col("ci_low").alias("lp"))
    c3 = c2.join(p, "arm", "left").select(F.lit("C3").alias("criterion"), "arm", F.coalesce(F.col("pass") & (F.col("lp") > 0) & (F.col("dp") >= PARAPHRASE_RATIO * F.col("delta")), F.lit(False)).alias("pass"))
    return c1.unionByName(c2.select(F.lit("C2").alias("criterion"), "arm", "pass")).unionByName(c3)


def kappa(labels: DataFrame) -> DataFrame:
    """n, agreement and Cohen's kappa of labels (a, b); 1 if chance alone would agree always, no row for no labels."""
    n = labels.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    ca, cb = labels.groupBy(F.col("a").alias("x")).agg(F.count("*").alias("ka")), labels.groupBy(F.col("b").alias("x")).agg(F.count("*").alias("kb"))
    chance = ca.join(cb, "x").agg(F.coalesce(F.sum(F.col("ka").cast("double") * F.col("kb")), F.lit(0.0)).alias("s"))
    pe = F.col("s") / (F.col("n").cast("double") * F.col("n"))
    both = n.crossJoin(chance).where("n > 0")  # two single rows
    return both.select("n", F.round("po", 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def set_f1(answers: DataFrame, aliases: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and f1 of the canonical names that answers (query_id, answer) mention, by aliases (alias, name), against gold (query_id, name)."""
    text = answers.select("query_id", answer_norm(F.col("answer")).alias("text"), F.col("answer"))
    from ..functions.text import abstained

    named = aliases.select("name", answer_norm(F.col("alias")).alias("alias")).where("alias <> ''")
    text = text.where(~abstained(F.col("answer"))).select("query_id", "text")
    # aliases that begin and end with a word meet the runs of as many words, wherever they stand whole: no text goes to an alias
    whole = F.regexp_like("alias", F.lit(r"(?s)^\w(.*\w)?$"))
    cores = named.where(whole).withColumn("n_words", F.size(F.regexp_extract_all("alias", F.lit(r"(\w+)"), F.lit(1))))
    sizes = cores.select("n_words").distinct()  # as many rows as an alias has words, at most
    split = lambda group: F.regexp_extract_all("text", F.lit(r"(\W*)(\w+)"), F.lit(group))
    runs = let(F.arrays_zip(split(1).alias("gap"), split(2).alias("word")), lambda parts: let(
        F.transform(parts, lambda x: F.concat(x["gap"], x["word"])),
        lambda glued: F.transform(F.sequence(F.lit(1), F.size(parts) - F.col("n_words") + 1), lambda i: F.when(
            ~F.endswith(F.get(parts, i - 1)["gap"], F.lit(".")),
            F.concat(F.get(parts, i - 1)["word"], F.array_join(F.slice(glued, i + 1, F.col("n_words") - 1), ""))))))
    enough = text.join(F.broadcast(sizes), F.size(split(2)) >= F.col("n_words"))
    met = enough.select("query_id", F.explode(F.array_distinct(F.array_compact(runs))).alias("alias")).join(cores, "alias").select("query_id", "name")
    # others are looked for only where their first word stands
    words = text.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("w"))
    rest = words.join(named.where(~whole).withColumn("w", F.regexp_extract("alias", r"(\w+)", 1)), "w").join(text, "query_id").where(has_token(F.col("text"), F.col("alias"))).select("query_id", "name")
    found = met.unionByName(rest).distinct()
    got = found.groupBy("query_id").agg(F.count("*").alias("n_got"))
    true = gold.select("query_id", "name").distinct()
    wanted = true.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = found.join(true, ["query_id", "name"]).groupBy("query_id").agg(F.count("*").alias("n_hit"))
    rows = answers.select("query_id").join(got, "query_id", "left").join(wanted, "query_id", "left").join(hit, "query_id", "left")
    p, r = F.col("n_hit") / F.col("n_got"), F.col("n_hit") / F.col("n_gold")
    return rows.select("query_id", F.round(F.coalesce(2 * p * r / (p + r), F.lit(0.0)), 6).alias("f1"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int = 8, seed: int = SEED) -> DataFrame:
    """n rows of each stratum, chosen by a seeded hash of the key: a sampling operator."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def shuffled(rows: DataFrame, kind: str, key: str, priority: Column, seed: int = SEED) -> DataFrame:
    """rows and place: within each kind, rows with priority first, in the order of a seeded hash of kind and key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(kind).cast("string"), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(F.coalesce(priority, F.lit(False)).desc(), order, key)).cast("long"))


def efficiency(timings: DataFrame, sizes: DataFrame) -> DataFrame:
    """arm, queries, p50_ms and p95_ms of timings (arm, seconds), and the other columns of sizes (arm, counts), 0 where an arm has none."""
    ms = F.col("seconds") * 1000
    measured = timings.groupBy("arm").agg(F.count("*").alias("queries"), F.round(F.percentile(ms, F.lit(0.5)), 3).alias("p50_ms"), F.round(F.percentile(ms, F.lit(0.95)), 3).alias("p95_ms"))
    others = [c for c in sizes.columns if c != "arm"]
    return measured.join(sizes, "arm", "left").select("arm", "queries", "p50_ms", "p95_ms", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in others])
