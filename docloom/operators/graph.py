"""Link graphs: neighbours, expansion of rankings, walks, and what titles name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_stem
from .lineage import cut, kept
from .ranking import DOCS, ordered_union, top

#: Weights of link kinds (fixed values).
EDGE_WEIGHTS = {"child": 1.0, "curated": 1.0, "related": 0.8, "prose": 0.6, "sibling": 0.2}


def weight(kind, weights: dict[str, float] = EDGE_WEIGHTS) -> F.Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), kind)


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, kind) in both directions, without loops."""
    both = edges.select("src", "dst", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    return both.where("src <> dst").distinct()


def near(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of undirected(edges) whose src is among paths (path). Other links go before repeated ones are looked for, so what is grouped are the neighbours of some paths, not all links."""
    at = kept(paths.select(F.col("path").alias("src")).distinct(), "near")
    both = edges.select("src", "dst", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    return both.where("src <> dst").join(at, "src", "left_semi").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours")).withColumnRenamed("src", "path")


def children_by_parent(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'child'").groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("children"))


def expand_weighted(ranked: DataFrame, edges: DataFrame, factor: float = 0.25, seeds: int = 5, k: int = DOCS, weights: dict[str, float] = EDGE_WEIGHTS) -> DataFrame:
    """Rankings (query_id, path, score, rank) after each of the first seeds has lent its neighbours a part of its score.

    Scores are shares of the best. A document gains the largest loan, not the sum; ties go to the
    earlier seed, then to the smaller path.
    """
    ranked = kept(ranked, "ranked")
    best = ranked.groupBy("query_id").agg(F.max("score").alias("_top"))
    base = ranked.join(best, "query_id").select("query_id", "path", "rank", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.lit(0.0)).alias("s"))
    lent = base.where(F.col("rank") <= seeds).select("query_id", F.col("path").alias("src"), "s")
    weighed = near(edges, ranked.where(F.col("rank") <= seeds)).groupBy("src", "dst").agg(F.max(weight(F.col("kind"), weights)).alias("w"))
    loans = lent.join(weighed, "src").groupBy("query_id", F.col("dst").alias("path")).agg(F.max(factor * F.col("w") * F.col("s")).alias("loan"))
    merged = base.join(loans, ["query_id", "path"], "full").select("query_id", "path", F.when(F.col("rank") <= seeds, F.col("rank")).otherwise(1 << 30).alias("_seed"), F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("loan", F.lit(0.0)), 9).alias("score"))
    return top(merged, k, F.col("score").desc(), F.col("_seed"), F.col("path")).drop("_seed")


def expand_docs(ranked: DataFrame, edges: DataFrame, seeds: int = 5, k: int = DOCS) -> DataFrame:
    """The first seeds, then their neighbours seed by seed (each by path), then the rest of the ranking."""
    ranked = kept(ranked, "ranked")
    first = ranked.where(F.col("rank") <= seeds)
    found = first.select("query_id", F.col("path").alias("src"), F.col("rank").alias("seed")).join(near(edges, first).select("src", "dst").distinct(), "src").groupBy("query_id", "dst").agg(F.min("seed").alias("seed"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seed", "dst"))
    tiers = first.select("query_id", F.lit(0).alias("tier"), F.col("rank").cast("int").alias("pos"), "path")
    tiers = tiers.unionByName(found.withColumn("pos", place).where(F.col("pos") <= k).select("query_id", F.lit(1).alias("tier"), "pos", F.col("dst").alias("path")))
    tiers = tiers.unionByName(ranked.where(F.col("rank") > seeds).select("query_id", F.lit(2).alias("tier"), F.col("rank").cast("int").alias("pos"), "path"))
    return ordered_union(tiers, "path", k)


def bfs(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """query_id, path and hop of what is reached from seeds (query_id, path, rank) by child or other links, and the rank of the seed that first reached it.

    A path is reached by the fewest hops; of several seeds by the best. One join a hop.
    """
    reached = seeds.groupBy("query_id", "path").agg(F.min("rank").alias("seed")).withColumn("hop", F.lit(0))
    frontier = reached = kept(reached, "reached")
    for hop in range(1, hops + 1):
        links = near(edges, frontier).select(F.col("src").alias("path"), "dst").distinct()
        step = frontier.join(links, "path").groupBy("query_id", F.col("dst").alias("path")).agg(F.min("seed").alias("seed"))
        frontier = kept(step.join(reached, ["query_id", "path"], "left_anti").withColumn("hop", F.lit(hop)), "reached")
        reached = reached.unionByName(frontier)
    return reached


def budgeted(ranked_units: DataFrame, units: DataFrame, edges: DataFrame, k: int = 10, budget: int = 5, hops: int = 1) -> DataFrame:
    """The first k - budget units, then up to budget units of documents reached from all k by links (by hop, seed, path, unit id as text), then the ranking again.

    ranked_units: query_id, unit_id, path, rank; units: unit_id, path.
    """
    seeds = ranked_units.where(F.col("rank") <= k)
    walked = bfs(seeds.select("query_id", "path", "rank"), edges, hops).where("hop > 0")
    head = seeds.where(F.col("rank") <= k - budget)
    new = walked.join(units, "path").join(head.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "seed", "path", F.col("unit_id").cast("string")))
    new = new.withColumn("pos", place).where(F.col("pos") <= budget)
    tiers = head.select("query_id", F.lit(0).alias("tier"), F.col("rank").cast("int").alias("pos"), "unit_id").unionByName(new.select("query_id", F.lit(1).alias("tier"), "pos", "unit_id"))
    return ordered_union(tiers.unionByName(seeds.select("query_id", F.lit(2).alias("tier"), F.col("rank").cast("int").alias("pos"), "unit_id")), "unit_id", k)


def title_match(questions: DataFrame, docs: DataFrame, exclude: tuple[str, ...] = ("home", "schema")) -> DataFrame:
    """query_id, path and n_words of the documents whose stemmed title stands whole in the stemmed question, longest first.

    Questions are cut into word n-grams of the titles' lengths, which meet titles in an equi-join.
    """
    titles = docs.where(~F.col("doc_type").isin(*exclude)).select("path", normalize_stem(F.col("title")).alias("t")).where(F.size("t") > 0)
    titles = titles.select("path", F.size("t").alias("n_words"), F.array_join("t", " ").alias("gram"))
    words = questions.select("query_id", normalize_stem(F.col("text")).alias("q"))
    sizes = titles.select("n_words").distinct()
    grams = words.join(sizes, F.size("q") >= F.col("n_words")).select("query_id", "n_words", F.explode(F.sequence(F.lit(1), F.size("q") - F.col("n_words") + 1)).alias("i"), "q")
    grams = grams.select("query_id", "n_words", F.array_join(F.slice("q", F.col("i"), F.col("n_words")), " ").alias("gram")).distinct()
    found = grams.join(titles, ["gram", "n_words"]).select("query_id", "path", F.col("n_words").cast("long"))
    return top(found, 1 << 30, F.col("n_words").desc(), F.col("path"))


def parent_aware(matches: DataFrame, wanted: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id and path: children, of the wanted type (query_id, doc_type), of the titles a question names."""
    parents = matches.join(docs.where("doc_type <> 'home'").select("path"), "path", "left_semi").select("query_id", F.col("path").alias("src"))
    kids = parents.join(edges.where("kind = 'child'").select("src", F.col("dst").alias("path")), "src").select("query_id", "path").distinct()
    return kids.join(docs.select("path", "doc_type"), "path").join(wanted, ["query_id", "doc_type"]).select("query_id", "path")


def two_step(matches: DataFrame, edges: DataFrame, similarity: DataFrame, fallback: DataFrame, entities: int = 3, k: int = DOCS) -> DataFrame:
    """Up to three named documents, then their neighbours by similarity (query_id, path, score; none: -1), then the fallback ranking."""
    named = kept(matches.where(F.col("rank") <= entities).select("query_id", "path", "rank"), "named")
    found = named.select("query_id", F.col("path").alias("src")).join(near(edges, named).select("src", "dst").distinct(), "src").select("query_id", F.col("dst").alias("path")).distinct()
    found = found.join(named.select("query_id", "path"), ["query_id", "path"], "left_anti").join(similarity, ["query_id", "path"], "left").fillna({"score": -1.0})
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path"))
    found = found.withColumn("pos", place).where(F.col("pos") <= k)
    tiers = named.select("query_id", F.lit(0).alias("tier"), F.col("rank").cast("int").alias("pos"), "path")
    tiers = tiers.unionByName(found.select("query_id", F.lit(1).alias("tier"), "pos", "path"))
    return ordered_union(tiers.unionByName(fallback.select("query_id", F.lit(2).alias("tier"), F.col("rank").cast("int").alias("pos"), "path")), "path", k)


def parent_chain(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """path, depth and root of each document's chain of parents, however long; ok is false where the chain leaves the documents or loops.

    Pointers double: each round a path learns the ancestor of its ancestor, so a chain of n links takes
    log2(n) rounds, each cut from its lineage. What has not ended after as many links as there are
    documents loops, and has neither root nor depth.
    """
    up = edges.where("kind = 'child'").groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("parent"))
    # at is the ancestor `depth` links up; ended: it has no parent
    chain = docs.select("path").join(up, "path", "left").select("path", F.coalesce("parent", "path").alias("at"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("ended"))
    chain, size, reach = cut(chain), docs.count(), 1
    while reach <= size and not chain.where("not ended").isEmpty():
        next_ = chain.select(F.col("path").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("ended").alias("_ended"))
        moves = ~F.col("ended") & F.col("_at").isNotNull()
        # an ancestor that is no document ends its chain
        chain = cut(chain.join(next_, "at", "left").select(
            "path", F.when(moves, F.col("_at")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.when(moves, F.col("_depth")).otherwise(0)).alias("depth"), (F.col("ended") | F.coalesce("_ended", F.lit(True))).alias("ended"),
        ))
        reach *= 2
    known = docs.select(F.col("path").alias("at"), F.lit(True).alias("_known"))
    told = lambda c: F.when(F.col("ended"), F.col(c))
    return chain.join(known, "at", "left").select("path", told("at").alias("root"), told("depth").alias("depth"), (F.col("ended") & F.coalesce("_known", F.lit(False))).alias("ok"))


def edge_agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """Shared undirected pairs of two link sets, and precision and recall of the second against the first."""
    pairs = lambda e: e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    marked = pairs(one).withColumn("x", F.lit(1)).join(pairs(two).withColumn("y", F.lit(1)), ["a", "b"], "full")
    counts = marked.agg(F.count("x").alias("n_one"), F.count("y").alias("n_two"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"))
    ratio = lambda n: F.round(F.coalesce(F.try_divide("shared", n), F.lit(0.0)), 6)
    return counts.select("n_one", "n_two", "shared", ratio("n_two").alias("precision"), ratio("n_one").alias("recall"))
