"""Audit of how filters interact: what each removes, in every order, from one pass over the documents.

A document's failures are a mask, one bit a filter. Per part, and per label within it, the 2**n
signed parity sums (Walsh-Hadamard coefficients) of the masks are plain sums, so they combine map-side
whatever the skew; the inverse transform gives the exact number of documents of each mask. All
orders are sums of those cells, so no order is run. A document that fails f of the n filters is removed
by each of these in n! / f of the orders, which is the Shapley numerator in closed form.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions of the filters that judge a text by itself, from the text and its words."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > F.lit(3) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _masked(docs: DataFrame) -> DataFrame:
    """id, part, digest (of the text) and the mask of text_failures, by the text's own columns."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    own = own.select("id", "part", "body", F.array_remove(F.split("body", SPACE), "").alias("words"))
    failures = text_failures(F.col("body"), F.col("words"))
    mask = sum((F.when(failed, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, failed in enumerate(failures.values())), F.lit(0))
    return own.select("id", "part", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: the documents of each part and label by the filters that they fail, in pieces to be summed.

    The last bit is set where a smaller doc_id has the same text, anywhere in the table. Texts meet
    by their SHA-256 only after their rows are one for each part and label, so a text that a third of all
    documents hold is as many rows. Null texts are empty, null ids equal no text of a smaller
    id, and a doc_id with several labels has what any of them says.
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = _masked(docs).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(told, "id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    alike = rows.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("first"))
    overall = alike.groupBy("digest").agg(F.min("first.id").alias("least"))
    alike = alike.join(overall, "digest")
    firsts = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n"))))
    return alike.select("part", "good", "toxic", split.alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n")


def _sign(mask: Column | int, w: int) -> Column:
    return F.when(F.bit_count(mask.bitwiseAND(F.lit(w))) % 2 == 1, F.lit(-1)).otherwise(F.lit(1))


def cells(masked: DataFrame, n_filters: int) -> DataFrame:
    """part and, as arrays by mask, the documents (every), those of good quality (good) and the toxic ones (toxic).

    Aggregates the signed parity sums of all masks, and inverts the transform exactly: it is its own inverse but
    for a factor of 2**n_filters.
    """
    size = 1 << n_filters
    weights = {"every": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    sums = [F.sum(_sign(F.col("mask"), w) * n).alias(f"{label}_{w}") for label, n in weights.items() for w in range(size)]
    parities = masked.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{label}_{w}" for w in range(size)]).alias(label) for label in weights])

    def inverse(label: str) -> Column:
        return F.expr(f"transform(sequence(0, {size - 1}), m -> aggregate(sequence(0, {size - 1}), 0L, (s, w) -> s + if(bit_count(m & w) % 2 = 1, -{label}[w], {label}[w])) div {size})")

    return parities.select("part", *[inverse(label).alias(label) for label in weights])


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the documents of each mask."""
    n = len(letters)
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    plan = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{p}}}' for o, s, b, p in steps) + "]"), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    each = cells.withColumn("_at", F.explode(plan)).select("part", "every", "good", "toxic", "_at.*")

    def total(label: str, where: str, weight: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {(1 << n) - 1}), 0L, (s, m) -> s + if({where}, {label}[m] * {weight}, 0L))")

    here = "(m & bit) != 0 and (m & before) = 0"
    return each.select(
        "part", "filter_order", "step", total("every", "(m & (bit | before)) = 0").alias("kept"), total("every", here).alias("removed"), total("every", "(m & bit) != 0 and (m & before) != 0").alias("redundant"),
        total("every", "m = bit").alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("every", "(m & bit) != 0", f"({math.factorial(n)}L div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What filters A to E (text_failures; E: repeated texts) remove from each part, in all orders.

    A part is a value of lang (null: empty string). Empty tables give no row. The table is read once; what
    is shuffled is an id, a digest and a mask a document.
    """
    return orders(cells(masks(docs, labels), 5), "ABCDE")
