"""Benchmark decontamination by winnowing.

A window is `span` consecutive item words (a shorter item is one window). Both sides keep
the smallest k-gram hash of every run of span - k + 1 k-grams, so each shared window holds
a shared fingerprint: no match of span words can be missed. Fingerprints of documents and
items are joined, and every hit is extended word by word in both directions.

The benchmark goes to the tasks in blocks of at most `block_bytes` of text, whatever its
size; the documents pass one map per block, in one stage and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import MUL_A, U64, boxed, give_back, mix


@dataclass(frozen=True)
class Winnowing:
    span: int = 13  # shortest shared run of words that counts
    k: int = 5
    block_bytes: int = 32 << 20  # benchmark text sent to the tasks at a time
    percent: int = 5  # contaminated: at least this share of the words is hit


#: A-Z in lower case; every other ASCII character but 0-9 and a-z divides words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0x20 for c in range(256))
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram of word ids; one with a word outside the benchmark (-1) is the largest value."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    known = ids >= 0
    bad = np.zeros(n, bool)
    h = np.zeros(n, U64)
    wide = ids.astype(U64)
    for i in range(k):
        h = h * MUL_A + wide[i : i + n] + U64(1)
        bad |= ~known[i : i + n]
    h = mix(h) >> U64(1)
    h[bad] = _NONE
    return h


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost smallest hash of some run of `width` hashes."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.arange(n - width + 1) + windows.argmin(axis=1)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return np.unique(at[hashes[at] != _NONE])


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple], rule: Winnowing) -> None:
        self.rule, self.vocabulary = rule, {}
        self.items, self.words, tables = [], [], {}
        for item_id, text in items:
            words = fold_words(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            number = len(self.items)
            self.items.append(item_id)
            self.words.append(ids)
            # an item shorter than the span is a window of its own length, found by its full hash
            k, width = (rule.k, rule.span - rule.k + 1) if len(ids) >= rule.span else (len(ids), 1)
            hashes = gram_hashes(ids, k)
            key = (k, width)
            for at in winnow(hashes, width).tolist():
                tables.setdefault(key, {}).setdefault(int(hashes[at]), []).append((number, at))
        self.tables = {key: (np.array(sorted(t), U64), t) for key, t in tables.items()}

    def scan(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, end word, item) of each maximal hit in the word ids of many documents."""
        for (k, width), (known, table) in self.tables.items():
            hashes = gram_hashes(ids, k)
            at = winnow(hashes, width) if width > 1 else np.arange(len(hashes))
            if not len(at):
                continue
            found = np.searchsorted(known, hashes[at])
            found[found == len(known)] = 0
            at = at[known[found] == hashes[at]]
            docs = np.searchsorted(starts, at, side="right") - 1
            for position, doc in zip(at.tolist(), docs.tolist()):
                low, high = int(starts[doc]), int(starts[doc + 1])
                if position + k > high:
                    continue
                for item, offset in table[int(hashes[position])]:
                    words = self.words[item]
                    left, right = 0, k
                    if (ids[position : position + k] != words[offset : offset + k]).any():
                        continue
                    while position - left > low and offset - left > 0 and ids[position - left - 1] == words[offset - left - 1]:
                        left += 1
                    while position + right < high and offset + right < len(words) and ids[position + right] == words[offset + right]:
                        right += 1
                    if left + right >= min(self.rule.span, len(words)):
                        yield doc, position - left, position + right, item


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan_part(shared, names: list[str]):
    """Adds one block's hits and items to those of the blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.vocabulary.get
        for batch in batches:
            ids: list[int] = []
            starts, out = [0], []

            def flush() -> None:
                spans: dict[int, list] = {}
                for doc, low, high, item in index.scan(np.array(ids, np.int64), np.array(starts, np.int64)):
                    spans.setdefault(doc, []).append((low - starts[doc], high - starts[doc], item))
                out.extend((starts[doc + 1] - starts[doc], spans.get(doc, ())) for doc in range(len(starts) - 1))

            for text in batch.column("_text"):
                ids += [get(w, -1) for w in fold_words(text.as_py())]
                starts.append(len(ids))
                if len(ids) > 500_000:
                    flush()
                    ids, starts = [], [0]
            flush()
            hits, items = [], []
            for (_, spans), had, named in zip(out, batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()):
                hits.append([{"start": a, "end": b} for a, b in merge([(h["start"], h["end"]) for h in had or ()] + [x[:2] for x in spans])])
                items.append(sorted({*(named or ()), *(str(index.items[x[2]]) for x in spans if index.items[x[2]] is not None)}))
            made = [batch.column("_text"), pa.array([n for n, _ in out], pa.int64()), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, [*names, "_text", "_words", "_hits", "_items"])
        give_back()

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The items, streamed to the driver in blocks of at most `limit` bytes of text (a longer item alone)."""
    block, held = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(row["text"]) if row["text"] is not None else None
        if block and held + len(text or b"") > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text or b"")
    yield block


def find(docs: DataFrame, benchmark: DataFrame, *columns: str, rule: Winnowing = Winnowing()) -> DataFrame:
    """The named columns of docs, n_words, hits (spans of word numbers) and items (ids as strings, sorted).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated
    items are all reported; a null item_id hits words but is listed as no item. Columns that are
    not named do not matter, whatever their names.
    """
    spans = "array<struct<start: bigint, end: bigint>>"
    source = docs.select(*columns, F.col("text").cast("binary").alias("_text"), F.lit(0).cast("long").alias("_words"), F.array().cast(spans).alias("_hits"), F.array().cast("array<string>").alias("_items"))
    schema = source.schema
    for items in benchmark_blocks(benchmark, rule.block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, rule))
        source = source.mapInArrow(_scan_part(index, list(columns)), schema)
    return source.select(*columns, F.col("_words").alias("n_words"), F.col("_hits").alias("hits"), F.col("_items").alias("items"))


def verdict(found: DataFrame, rule: Winnowing = Winnowing()) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.expr("aggregate(hits, 0L, (s, h) -> s + h.end - h.start)")
    return found.withColumn("n_hit", n_hit).withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= rule.percent * F.col("n_words")),
    })


def keep(docs: DataFrame, benchmark: DataFrame, rule: Winnowing = Winnowing()) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' columns."""
    return verdict(find(boxed(docs, "text"), benchmark, "_boxed", rule=rule), rule).where("not contaminated").select("_boxed.*")


__all__ = ["Winnowing", "find", "verdict", "keep", "fold_words", "merge"]
