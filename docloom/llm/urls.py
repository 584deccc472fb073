"""URL filters: explicit rules, and a tree of path templates for what no rule tells.

Rules name a host, which holds for its subdomains too, and a path prefix. For the other URLs a tree of
path templates is grown per host, level by level, from aggregated counts only:

* segments that look variable (they hold a digit, or are long) are wildcards from the start, so that pages become
  few path shapes;
* a node most of whose children are seen once is variable: all its children are one wildcard;
* children whose outcomes (labelled bad, labelled good, unlabelled; ends here or goes on) do not differ from the
  whole node's, by a chi-square test, are merged into one wildcard; those that differ keep their names. A child is
  compared with the node and not with each other child, so the work is linear in the children.

A template is rejected if its labelled purity, smoothed towards the host's share of bad pages and that towards
the corpus', reaches a threshold. URLs that a rule decides are labelled by it; other labels may be passed.
All levels are groupings and equi-joins of shapes: no host is a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import boxed, saved


@dataclass(frozen=True)
class UrlRule:
    prefix: str  # host/path
    block: bool


@dataclass(frozen=True)
class TemplateModel:
    depth: int = 4  # levels of the tree; what is deeper is one wildcard for the rest
    long_segment: int = 40  # segments of more characters are variable
    variable_children: int = 12  # a node with as many children or more, most of them seen once, is variable
    chi_square: float = 7.815  # 5 % point at three degrees of freedom
    weight: float = 4.0  # of the host's share in a template's purity, and of the corpus' in the host's
    reject_at: float = 0.8


#: The rules of the registered query.
RULES = [UrlRule("net/", True), UrlRule("example.net/en/", False), UrlRule("example.com/de/", True), UrlRule("org/fr/", False)]
#: Rules stand in the plan, as a map by host; more are refused.
MOST_RULES = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a URL; both empty for null and where there is no `://`."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as struct(length, rule, block); null if none does. Of equal prefixes, blocking wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules stand in a plan")
    by_host: dict[str, list[UrlRule]] = {}
    for rule in rules:
        by_host.setdefault(rule.prefix.partition("/")[0].lower(), []).append(rule)
    if not by_host:
        return F.lit(None).cast("struct<length: int, rule: string, block: boolean>")
    one = lambda r: F.struct(F.lit(len(r.prefix)).alias("length"), F.lit(r.prefix).alias("rule"), F.lit(r.block).alias("block"), F.lit("/" + r.prefix.partition("/")[2]).alias("path"))
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*map(one, own)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(table[s], F.array().cast("array<struct<length: int, rule: string, block: boolean, path: string>>"))))
    return F.array_max(F.transform(F.filter(found, lambda r: F.startswith(path, r["path"])), lambda r: F.struct(r["length"], r["rule"], r["block"])))


def shape(path: Column, model: TemplateModel) -> Column:
    """The segments of a path; variable ones are `*`, and those below the tree's depth `**`."""
    segments = F.array_remove(F.split(path, "/"), "")
    named = F.transform(F.slice(segments, 1, model.depth), lambda s: F.when(s.rlike(r"[0-9]") | (F.length(s) > model.long_segment), F.lit("*")).otherwise(s))
    return F.concat(named, F.when(F.size(segments) > model.depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


_OUTCOMES = ("bad_end", "bad_on", "good_end", "good_on", "open_end", "open_on")


def _outcomes(level: int) -> list[Column]:
    """Pages by label, and by whether their path ends at this level."""
    ends = F.size("segs") == level
    opened = F.col("n") - F.col("bad") - F.col("good")
    return [F.sum(F.when(ends if at == "end" else ~ends, n).otherwise(0)).alias(f"{label}_{at}") for label, n in (("bad", F.col("bad")), ("good", F.col("good")), ("open", opened)) for at in ("end", "on")]


def _level(shapes: DataFrame, level: int, model: TemplateModel) -> DataFrame:
    """shapes with this level's segment, as the tree tells it, appended to made."""
    deep = shapes.where(F.size("segs") >= level).withColumn("seg", F.element_at("segs", level))
    nodes = saved(deep.groupBy("host", "made", "seg").agg(F.sum("n").alias("n"), *_outcomes(level)), "url-nodes")
    parents = nodes.groupBy("host", "made").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum((F.col("n") == 1).cast("long")).alias("single"), *[F.sum(c).alias(f"all_{c}") for c in _OUTCOMES])
    parents = parents.select(*[F.col(c).alias({"host": "p_host", "made": "p_made"}.get(c, c)) for c in parents.columns])
    both = nodes.join(parents, (F.col("host") == F.col("p_host")) & (F.col("made") == F.col("p_made")))
    parts = []
    for c in _OUTCOMES:
        expected = F.col("n").cast("double") * F.col(f"all_{c}") / F.col("all_n")
        parts.append(F.when(F.col(f"all_{c}") > 0, (F.col(c) - expected) * (F.col(c) - expected) / expected).otherwise(F.lit(0.0)))
    chi = parts[0]
    for part in parts[1:]:
        chi = chi + part
    variable = (F.col("kids") >= model.variable_children) & (2 * F.col("single") > F.col("kids"))
    alike = (F.col("kids") > 1) & (chi <= model.chi_square)
    name = F.when(F.col("seg").isin("*", "**") | ~(variable | alike), F.col("seg")).otherwise(F.lit("*"))
    named = both.select(F.col("host").alias("n_host"), F.col("made").alias("n_made"), F.col("seg").alias("n_seg"), name.alias("name"))
    kept = shapes.where(F.size("segs") < level)
    grown = deep.join(named, (F.col("host") == F.col("n_host")) & (F.col("made") == F.col("n_made")) & (F.col("seg") == F.col("n_seg")))
    return kept.unionByName(grown.select("host", "segs", "n", "bad", "good", F.concat_ws("/", "made", "name").alias("made")))


def templates(pages: DataFrame, model: TemplateModel) -> DataFrame:
    """host, segs, template, n_bad, n_good (labelled pages of the template) and rejected, one row for each path shape, from pages (host, segs, bad: boolean or null)."""
    count = lambda x: F.sum(x.cast("long"))
    shapes = pages.groupBy("host", "segs").agg(F.count("*").alias("n"), F.coalesce(count(F.col("bad")), F.lit(0)).alias("bad"), F.coalesce(count(~F.col("bad")), F.lit(0)).alias("good"))
    shapes = saved(shapes.withColumn("made", F.lit("")), "url-shapes")
    tree = shapes
    for level in range(1, model.depth + 2):
        if tree.where(F.size("segs") >= level).isEmpty():
            break
        tree = saved(_level(tree, level, model), "url-tree")
    whole = shapes.agg(F.sum("bad").alias("w_bad"), F.sum(F.col("bad") + F.col("good")).alias("w_all"))
    hosts = shapes.groupBy(F.col("host").alias("h_host")).agg(F.sum("bad").alias("h_bad"), F.sum(F.col("bad") + F.col("good")).alias("h_all"))
    sums = tree.groupBy(F.col("host").alias("t_host"), F.col("made").alias("t_made")).agg(F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good"))
    share = F.when(F.col("w_all") > 0, F.col("w_bad").cast("double") / F.col("w_all")).otherwise(F.lit(0.0))
    prior = (F.col("h_bad") + F.lit(model.weight) * share) / (F.col("h_all") + F.lit(model.weight))
    purity = (F.col("n_bad") + F.lit(model.weight) * prior) / (F.col("n_bad") + F.col("n_good") + F.lit(model.weight))
    judged = sums.join(hosts, F.col("t_host") == F.col("h_host")).crossJoin(F.broadcast(whole)).select("t_host", "t_made", "n_bad", "n_good", (purity >= model.reject_at).alias("rejected"))
    found = tree.join(judged, (F.col("host") == F.col("t_host")) & (F.col("made") == F.col("t_made")))
    return found.select("host", "segs", F.when(F.col("made") == "", F.lit("/")).otherwise(F.col("made")).alias("template"), "n_bad", "n_good", "rejected")


def judge(pages: DataFrame, *keep: str, rules: list[UrlRule] = RULES, model: TemplateModel = TemplateModel(), bad: str | None = None) -> DataFrame:
    """The kept columns with host, path, rule, verdict, template, n_bad and n_good of each row's url.

    verdict is the longest fitting rule's, else block where the path's template is rejected, else allow. bad: a
    boolean column of pages that labels those which no rule decides; null: unlabelled. URLs that are null or have no
    `://` have empty hosts and paths, and are one host without segments. Repeated rows count as often as they stand.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    own = boxed(pages, "url", *([bad] if bad else []))
    own = own.select("_boxed", host.alias("host"), path.alias("path"), (F.col(bad) if bad else F.lit(None).cast("boolean")).alias("_label"))
    own = own.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", shape(F.col("path"), model))
    known = templates(own.select("host", "segs", F.coalesce("_rule.block", "_label").alias("bad")), model)
    found = own.join(known.withColumnsRenamed({"host": "k_host", "segs": "k_segs"}), (F.col("host") == F.col("k_host")) & (F.col("segs") == F.col("k_segs")), "left")
    block = F.coalesce(F.col("_rule.block"), F.col("rejected"), F.lit(False))
    return found.select(*[F.col("_boxed")[c].alias(c) for c in keep], "host", "path", F.col("_rule.rule").alias("rule"), F.when(block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "template", "n_bad", "n_good")
