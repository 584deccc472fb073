"""Removal of repeated token windows by Rabin-Karp hashes counted in Spark.

Every window of `window` consecutive words of every document is hashed by prefix sums
(Rabin-Karp), and every hash is counted: each block of documents sends its distinct hashes,
shortened and packed, to hash buckets, which answer with those found twice. A second round
resolves, by full hashes, which block holds the earliest of each repeated window; inside a block
the order is known. Windows that are not the earliest merge into maximal removal intervals.

Shortened hashes carry 10 bits more than the corpus' windows need, so one in 1000 windows at
most goes to the second round for nothing; there 96 bits tell windows apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answers, block_count, blocked, bucket_edges, in_order, member, pack_fixed, unpack_fixed
from .core import U64, PrefixHash, WordHasher, buffers, give_back, mix, pack_sorted, runs_of, source_bytes, steps, unpack_sorted, widened

STEP = 1 << 18
_SIGN = U64(1 << 63)
_LAST = U64(0xFFFFFFFFFFFFFFFF)


class Windows:
    """The words and window hashes of one block, its texts in order."""

    def __init__(self, table: pa.Table, window: int, second: bool = False) -> None:
        raw, offsets = buffers(table["_text"])
        hasher = WordHasher()
        words, bounds = [], [np.zeros(1, np.int64)]
        total = 0
        for i, j in steps(offsets, STEP):
            found, _, _, edges = hasher(raw, offsets[i : j + 1])
            words.append(found)
            bounds.append(edges[1:] + total)
            total += len(found)
        self.words = np.concatenate(words) if words else np.zeros(0, U64)
        self.bounds = np.concatenate(bounds)
        at = np.arange(max(0, total - window + 1))
        ends = self.bounds[1:][np.searchsorted(self.bounds[1:], at, side="right")] if len(at) else at
        self.at = at[at + window <= ends]
        self.hashes = self._roll(PrefixHash(0x8CB92BA72F3D8DD7), window)
        self.second = self._roll(PrefixHash(0xB5297A4D2F7E6B9B), window) if second else None

    def _roll(self, rolling: PrefixHash, window: int) -> np.ndarray:
        sums = rolling.sums(self.words)
        return mix(rolling.spans(sums, self.at, self.at + window))


def _first_round(window: int, bits: int, bucket_bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        short = np.sort(Windows(table, window).hashes >> U64(64 - bits))
        keep = np.ones(len(short), bool)
        keep[1:] = short[1:] != short[:-1]
        again = np.zeros(len(short), bool)
        again[:-1] = ~keep[1:]
        again = again[keep]
        short = short[keep]
        edges = bucket_edges(short, bits, bucket_bits)
        rows = [(b, key[0].as_py(), pack_sorted(short[lo:hi]), pack_sorted(short[lo:hi][again[lo:hi]])) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if lo < hi]
        give_back()
        return _table(rows, ["bucket", "block", "blob", "again"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _table(rows, names, kinds) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _repeated(table: pa.Table) -> pa.Table:
    """The hashes of one bucket that some block has twice or that two blocks have, for each block that has them."""
    blocks = table["block"].to_pylist()
    lists = [unpack_sorted(b) for b in table["blob"].to_pylist()]
    again = [unpack_sorted(b) for b in table["again"].to_pylist()]
    every = np.sort(np.concatenate(lists + again))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    rows = [(block, pack_sorted(found)) for block, own in zip(blocks, lists) if len(found := own[member(own, repeated)])]
    return _table(rows, ["block", "blob"], [pa.int32(), pa.binary()])


def _second_round(window: int, bits: int, bucket_bits: int):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if found.num_rows:
            docs = in_order(docs)
            own = Windows(docs, window, second=True)
            hit = np.flatnonzero(member(own.hashes >> U64(64 - bits), answers(found)))
            hit = hit[np.argsort(own.hashes[hit], kind="stable")]  # stable: the first of equal hashes is the earliest
            hashes = own.hashes[hit]
            first = np.ones(len(hit), bool)
            first[1:] = hashes[1:] != hashes[:-1]
            hit, hashes = hit[first], hashes[first]
            doc = np.searchsorted(own.bounds, own.at[hit], side="right") - 1
            ids = docs["_id"].to_numpy(zero_copy_only=False) if not docs["_id"].null_count else None
            if ids is None:
                order = np.array([_LAST if x is None else U64((x + (1 << 63)) & 0xFFFFFFFFFFFFFFFF) for x in docs["_id"].to_pylist()], U64)
            else:
                order = ids.astype(np.int64).view(U64) ^ _SIGN
            order = order[doc]
            check = own.second[hit] >> U64(32)
            edges = bucket_edges(hashes, 64, bucket_bits)
            rows = [(b, key[0].as_py(), pack_sorted(hashes[lo:hi]), pack_fixed(order[lo:hi]), check[lo:hi].astype("<u4").tobytes()) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if lo < hi]
        give_back()
        return _table(rows, ["bucket", "block", "blob", "first", "checks"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _not_first(table: pa.Table) -> pa.Table:
    """For each block, the hashes of one bucket whose earliest window is in another block."""
    blocks = np.array(table["block"].to_pylist(), np.int64)
    lists = [unpack_sorted(b) for b in table["blob"].to_pylist()]
    block = np.repeat(blocks, [len(x) for x in lists])
    hashes = np.concatenate(lists)
    order = np.concatenate([unpack_fixed(b) for b in table["first"].to_pylist()])
    check = np.concatenate([np.frombuffer(b, "<u4") for b in table["checks"].to_pylist()])
    by = np.lexsort((block, order, check, hashes))
    later = np.zeros(len(by), bool)
    later[1:] = (hashes[by][1:] == hashes[by][:-1]) & (check[by][1:] == check[by][:-1])
    gone = by[later]
    rows = []
    for b in np.unique(block[gone]).tolist():
        rows.append((b, pack_sorted(np.sort(hashes[gone[block[gone] == b]]))))
    return _table(rows, ["block", "blob"], [pa.int32(), pa.binary()])


def _remove(window: int, row_type: pa.DataType | None = None):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = in_order(docs)
        own = Windows(docs, window)
        by = np.argsort(own.hashes, kind="stable")
        later = np.zeros(len(by), bool)
        ordered = own.hashes[by]
        later[1:] = ordered[1:] == ordered[:-1]
        gone = np.zeros(len(by), bool)
        gone[by[later]] = True
        gone |= member(own.hashes, answers(found))
        edge = np.zeros(len(own.words) + 1, np.int32)
        np.add.at(edge, own.at[gone], 1)
        np.add.at(edge, own.at[gone] + window, -1)
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        spans, kept, sizes = [], [], []
        for i, text in enumerate(docs["_text"]):
            lo, hi = own.bounds[i], own.bounds[i + 1]
            mask = covered[lo:hi]
            words = text.as_py().split()
            sizes.append(len(words))
            if mask.any():
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(*runs_of(mask))])
                words = [w for w, out in zip(words, mask.tolist()) if not out]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        row = docs["_row"].combine_chunks() if isinstance(docs["_row"], pa.ChunkedArray) else docs["_row"]
        give_back()
        return pa.Table.from_arrays([row, pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["_row", "n_words", "removed", "kept"])

    return run


def dedup(docs: DataFrame, *columns: str, window: int = 20) -> DataFrame:
    """The named columns of docs, n_words, removed (maximal intervals of word numbers) and kept (the words left, joined by one space).

    docs has doc_id (whole numbers) and text. A window goes if its words also start earlier:
    in a smaller doc_id (null: after all others), or earlier in the same document. Of rows with
    one doc_id, equal texts count as a document and its repetition; different texts are ordered by
    block and hash. Null and empty texts have no words; texts shorter than a window stay whole.
    Other columns of docs do not matter, whatever their names.
    """
    count = block_count(docs)
    bits = min(62, max(24, math.ceil(math.log2(max(2, source_bytes(docs) / 2))) + 10))
    bucket_bits = min(16, max(2, math.ceil(math.log2(count))))
    blocks = blocked(docs, count, list(columns))
    sent = blocks.groupBy("_block").applyInArrow(_first_round(window, bits, bucket_bits), "bucket int, block int, blob binary, again binary")
    repeated = sent.groupBy("bucket").applyInArrow(_repeated, "block int, blob binary")
    sent = blocks.groupBy("_block").cogroup(repeated.groupBy("block")).applyInArrow(_second_round(window, bits, bucket_bits), "bucket int, block int, blob binary, first binary, checks binary")
    later = sent.groupBy("bucket").applyInArrow(_not_first, "block int, blob binary")
    done = blocks.groupBy("_block").cogroup(later.groupBy("block")).applyInArrow(_remove(window), widened(blocks, ["_row"], "n_words long, removed array<struct<start: long, end: long>>, kept binary"))
    return done.select("_row.*", "n_words", "removed", F.col("kept").cast("string").alias("kept"))
