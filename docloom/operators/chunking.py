"""Chunking documents, ordering evidence and packing contexts to a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import fenced_flags
from ..functions.text import whitespace_tokens


def chunk_flat(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """docs' columns but text, ord and text of each window of `size` whitespace tokens; windows overlap by `overlap`.

    A text without words has no chunk; the last window is the first that reaches the end.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    words = docs.withColumn("_words", whitespace_tokens(F.col("text"))).where(F.size("_words") > 0)
    count = F.greatest(F.ceil((F.size("_words") - F.lit(size)) / F.lit(float(step))), F.lit(0)).cast("int")
    starts = words.withColumn("ord", F.explode(F.sequence(F.lit(0), count)))
    return starts.withColumn("text", F.array_join(F.slice("_words", F.col("ord") * step + 1, size), " ")).drop("_words")


def chunk_flat_tokens(docs: DataFrame, count_tokens: Callable[[str], int], size: int = 512, overlap: int = 50) -> DataFrame:
    """As chunk_flat, with any token counter: a window is the longest run of words within `size` tokens, one word at least."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ord int, text string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                text = row.pop("text")
                rows += [{**row, "ord": i, "text": t} for i, t in enumerate(token_windows((text or "").split(), count_tokens, size, overlap))]
            yield pd.DataFrame(rows, columns=[*(f.name for f in kept), "ord", "text"])

    return docs.mapInPandas(run, schema)


def token_windows(words: list[str], count_tokens: Callable[[str], int], size: int, overlap: int) -> list[str]:
    def fits(a: int, b: int, limit: int) -> bool:
        return count_tokens(" ".join(words[a:b])) <= limit

    def last(low: int, high: int, good: Callable[[int], bool]) -> int:
        """The last value from low to high that is good, good being true up to some value; low counts as good.

        Steps double before they halve, so what is counted does not grow with the rest of a text.
        """
        step = 1
        while low + step < high and good(low + step):
            low, step = low + step, 2 * step
        high = min(high, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if good(middle) else (low, middle - 1)
        return low

    out, start, covered = [], 0, 0
    while start < len(words):
        end = last(start + 1, len(words), lambda e: fits(start, e, size))
        if end > covered:
            out.append(" ".join(words[start:end]))
            covered = end
        if end == len(words):
            break
        back = last(0, end - start - 1, lambda n: fits(end - n, end, overlap)) if overlap else 0
        start = max(end - back, start + 1)
    return out


HEADING = r"^#{1,6}\s+\S"


def chunk_struct(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks by heading: key (path), ord, heading_path and text of docs (path, text).

    Headings in fences do not count. A preamble stays if it is not blank; sections that are
    only a heading join the next one, under its heading path; longer ones than `size` tokens are
    cut as chunk_flat does; white space is squeezed.
    """
    lines = docs.select("path", F.split("text", "\n").alias("lines")).withColumn("fenced", fenced_flags(F.col("lines")))
    each = lines.select("path", F.posexplode(F.arrays_zip("lines", "fenced")).alias("n", "x")).select("path", "n", F.col("x.lines").alias("line"), F.col("x.fenced").alias("fenced"))
    each = each.withColumn("level", F.when(~F.col("fenced") & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", "^(#{1,6})", 1))))
    by = Window.partitionBy("path").orderBy("n")
    each = each.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(by))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    sections = each.groupBy("path", "section").agg(
        F.max("level").alias("level"),
        F.max_by(F.when(F.col("level").isNotNull(), title), F.col("level").isNotNull()).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("text"),
        (F.count_if(F.col("level").isNull() & (F.trim("line") != "")) == 0).alias("bare"),
    ).where(F.col("level").isNotNull() | ~F.col("bare"))
    sections = sections.withColumn("bare", F.col("bare") & F.col("level").isNotNull())
    # a section's heading path: the last heading of each smaller level that no smaller one has replaced since
    ranked = Window.partitionBy("path").orderBy("section")
    seen = F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "title"))).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    stacked = F.aggregate(
        seen,
        F.array().cast("array<struct<level: int, title: string>>"),
        lambda stack, h: F.concat(F.filter(stack, lambda s: s["level"] < h["level"]), F.array(F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title")))),
    )
    sections = sections.withColumn("heading_path", F.when(F.col("level").isNotNull(), F.transform(stacked, lambda s: s["title"])).otherwise(F.array().cast("array<string>")))
    # islands: a run of bare headings and the section it leads to
    island = F.coalesce(F.sum(F.when(F.col("bare"), 0).otherwise(1)).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sections = sections.withColumn("island", island)
    folded = sections.groupBy("path", "island").agg(
        F.max_by("heading_path", "section").alias("heading_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda s: s["text"]), "\n").alias("text"),
    )
    parts = chunk_flat(folded, size, overlap).withColumnRenamed("ord", "part")
    order = Window.partitionBy("path").orderBy("island", "part")
    return parts.select("path", (F.row_number().over(order) - 1).cast("long").alias("ord"), "heading_path", "text")


def evidence_order(ranked_docs: DataFrame, sections: DataFrame, k: int | None = None) -> DataFrame:
    """The sections (doc, ord) of ranked documents (query_id, doc, rank): first sections of all documents by rank, then second ones."""
    joined = sections.join(ranked_docs, "doc")
    place = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("ord"))
    placed = joined.withColumn("place", place)
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "rank")).cast("long")
    out = placed.withColumn("position", position)
    return out.where(F.col("position") <= k) if k else out


def pack_context(passages: DataFrame, budget: int = 2048) -> DataFrame:
    """Passages (query_id, position, path, text) that fit the budget in order, by whitespace tokens.

    A passage costs its header "Source: path" and its text. Packing ends where a header alone
    does not leave room; the last passage is cut to what fits. tokens is what each takes.
    """
    words = whitespace_tokens(F.col("text"))
    sized = passages.withColumn("_words", words).withColumn("_header", F.size(whitespace_tokens(F.concat(F.lit("Source: "), F.col("path")))))
    before = F.coalesce(F.sum(F.col("_header") + F.size("_words")).over(Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - F.col("_before") - F.col("_header")
    kept = sized.withColumn("_before", before).withColumn("_room", room).where("_room > 0")
    taken = F.least(F.size("_words"), F.col("_room")).cast("int")
    return kept.withColumn("text", F.array_join(F.slice("_words", F.lit(1), taken), " ")).withColumn("tokens", (F.col("_header") + taken).cast("long")).drop("_words", "_header", "_before", "_room")


def pack_context_tokens(passages: DataFrame, encode: Callable[[str], list], decode: Callable[[list], str], budget: int = 2048) -> DataFrame:
    """query_id, context, n_passages, tokens and clipped: passages (query_id, position, path, text) in order, as the tokenizer counts the whole context.

    Each is "Source: path" between line ends, and its text. Packing ends where a header leaves no room, or after
    a passage cut to the most ids that fit. Blank texts add nothing. A query's passages meet in one task, so
    they should be a ranking's first ones.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        context, n, clipped = "", 0, False
        for path, text in frame.sort_values("position")[["path", "text"]].itertuples(index=False):
            text = text or ""
            head = f"{context}\nSource: {path}\n"
            if len(encode(head)) >= budget:
                break
            body = text
            if len(encode(head + text)) > budget:
                ids = encode(text)
                low, high = 0, len(ids)
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if len(encode(head + decode(ids[:middle]))) <= budget else (low, middle - 1)
                body = decode(ids[:low])
            clipped = body != text
            if body:
                context, n = head + body, n + 1
            if clipped:
                break
        return pd.DataFrame([(*key, context, n, len(encode(context)), clipped)], columns=["query_id", "context", "n_passages", "tokens", "clipped"])

    kind = passages.schema["query_id"].dataType.simpleString()
    return passages.select("query_id", "position", "path", "text").groupBy("query_id").applyInPandas(run, f"query_id {kind}, context string, n_passages long, tokens long, clipped boolean")


def numbered_documentation(passages: DataFrame) -> DataFrame:
    """query_id and documentation: passages (position, path, text) as [i] path, line by line."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    entry = F.concat(F.lit("["), F.col("_i"), F.lit("] "), F.col("path"), F.lit("\n"), F.col("text"))
    rows = passages.withColumn("_i", place).withColumn("_entry", entry)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_entry"))), lambda s: s["_entry"])
    return rows.groupBy("query_id").agg(F.array_join(listed, "\n\n").alias("documentation"), F.count("*").alias("n_passages"))
