"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of all training documents are summed in hash buckets. Each count is
quantised on a logarithmic scale (small counts keep their value), and the events (n-gram, 1) to
(n-gram, level) enter a Bloom filter; each bucket fills its own segment of it, of `bits_each` bits
for each of its events, so that the filter grows with the corpus and its share of false positives
does not. No task and no driver holds more of it than a segment: blocks of documents ask the
buckets for their own words and pairs. A count is read by probing level after level until one is
missing; no pair is read as more frequent than its words.

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | v) = pair_weight * c(v w) / c(v) + (1 - pair_weight) * p(w)

with every count read from the filter. The base score needs exact counts of all words, which no
filter gives: the buckets answer those of each block's words too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, blocked, bucket_edges, in_order, pack_fixed, unpack_fixed
from .core import MUL_A, MUL_C, U64, WordHasher, buffers, distinct, give_back, mix, pack_sorted, ranked, saved, steps, unpack_sorted, widened
from .substring import _table

STEP = 1 << 18
ASKED = 64  # blocks that a bucket answers at a time
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


@dataclass(frozen=True)
class FilterModel:
    bits_each: int = 16  # bits of the filter for each event
    probes: int = 3  # bits of an event
    spacing: float = 1.15  # of the quantised counts
    pair_weight: float = 0.3
    pair_bits: int = 48  # of a pair's hash while it is counted
    tokens_each: int = 1_500_000  # words that a task counts before it sends


def levels(spacing: float) -> np.ndarray:
    """The smallest count of each level."""
    out, x = [1], 1.0
    while x < 2.0**62:
        x = max(x * spacing, out[-1] + 1)
        out.append(int(x))
    return np.array(out, np.float64)


class Tokens:
    """Word hashes of texts, each with an end, and the hashes of the pairs that end at each."""

    def __init__(self) -> None:
        self.hasher = WordHasher(lower=True)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, the word before, pair, n + 1 bounds)"""
        words, _, _, edges = self.hasher(raw, offsets)
        words = np.insert(words, edges[1:], END)
        bounds = edges + np.arange(len(edges))
        before = np.empty(len(words), U64)
        before[1:] = words[:-1]
        before[bounds[:-1]] = BEGIN
        return words, before, mix(before * MUL_A + mix(words)), bounds


def _sent(words: list[np.ndarray], pairs: list[np.ndarray], bits: int, bucket_bits: int) -> pa.RecordBatch:
    rows = []
    for kind, parts, width in ((0, words, 64), (1, pairs, bits)):
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        edges = bucket_edges(values, width, bucket_bits)
        rows += [(b, kind, pack_sorted(values[lo:hi]), pack_fixed(counts[lo:hi].astype(U64))) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if lo < hi]
    return _table(rows, ["bucket", "kind", "blob", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]).combine_chunks().to_batches()[0]


def _count_part(model: FilterModel, bits: int, bucket_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, words, pairs, held = Tokens(), [], [], 0
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            for i, j in steps(offsets, STEP):
                own, before, both, bounds = make(raw, offsets[i : j + 1])
                # the begin of each text is counted as a context
                words += [own, np.full(j - i, BEGIN)]
                pairs.append(both >> U64(64 - bits))
                held += len(own)
                if held >= model.tokens_each:
                    yield _sent(words, pairs, bits, bucket_bits)
                    words, pairs, held = [], [], 0
        if held:
            yield _sent(words, pairs, bits, bucket_bits)
        give_back()

    return run


def _positions(event: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    shift = (level * int(MUL_A) + (probe + 1) * int(MUL_C)) & 0xFFFFFFFFFFFFFFFF
    return mix(event + U64(shift)) % U64(size)


def _fill(model: FilterModel, segment_bits: int | None = None):
    """The exact counts of one bucket's words, and its segment: of segment_bits, or by its number of events."""
    edges = levels(model.spacing)

    def run(table: pa.Table) -> pa.Table:
        out, put = {}, []
        bucket = table["bucket"][0].as_py()
        kinds = np.array(table["kind"].to_pylist())
        blobs, counts = table["blob"].to_pylist(), table["counts"].to_pylist()
        for kind in (0, 1):
            at = np.flatnonzero(kinds == kind).tolist()
            if not at:
                continue
            values = np.concatenate([unpack_sorted(blobs[i]) for i in at])
            n = np.concatenate([unpack_fixed(counts[i]) for i in at]).astype(np.int64)
            by = np.argsort(values, kind="stable")
            values, n = values[by], n[by]
            start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            values, n = values[start], np.add.reduceat(n, start)
            top = np.searchsorted(edges, n, side="right")
            put.append((mix(values + U64(kind)), top))
            if kind == 0:
                word = values != BEGIN
                out = {"blob": pack_sorted(values[word]), "counts": pack_fixed(n[word].astype(U64)), "distinct": int(word.sum()), "tokens": int(n[word].sum())}
        size = segment_bits or max(64, -(-model.bits_each * sum(int(top.sum()) for _, top in put) // 64) * 64)
        bits = np.zeros(size, bool)
        for event, top in put:
            level = 1
            while len(event):
                for probe in range(model.probes):
                    bits[_positions(event, level, probe, size).astype(np.int64)] = True
                level += 1
                on = top >= level
                event, top = event[on], top[on]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "blob": pa.array([out.get("blob", b"")], pa.binary()), "counts": pa.array([out.get("counts", b"")], pa.binary()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "distinct": pa.array([out.get("distinct", 0)], pa.int64()), "tokens": pa.array([out.get("tokens", 0)], pa.int64())})

    return run


class Filter:
    """Reads quantised counts by repeated membership probes."""

    def __init__(self, data: np.ndarray, segment_bits: int, bits: int, bucket_bits: int, model: FilterModel) -> None:
        self.data, self.segment, self.bits, self.bucket_bits, self.model = data, segment_bits, bits, bucket_bits, model
        self.edges = levels(model.spacing)

    def levels(self, values: np.ndarray, kind: int) -> np.ndarray:
        """The number of levels found of each value; 0 if none is."""
        width = 64 if kind == 0 else self.bits
        bucket = (values >> U64(width - self.bucket_bits)).astype(np.int64) * self.segment if self.bucket_bits else np.zeros(len(values), np.int64)
        event, found = mix(values + U64(kind)), np.zeros(len(values), np.int64)
        alive, level = np.arange(len(values)), 1
        while len(alive) and level <= len(self.edges):
            for probe in range(self.model.probes):
                at = bucket[alive] + _positions(event[alive], level, probe, self.segment).astype(np.int64)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            found[alive] = level
            level += 1
        return found

    def counts(self, values: np.ndarray, kind: int) -> np.ndarray:
        """The smallest counts that the events found stand for; 0 if none is found."""
        return np.concatenate(([0.0], self.edges))[self.levels(values, kind)]


def _asked(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, the begin of texts first; its pairs; the words' bounds by texts; and which words begin a text."""
    raw, offsets = buffers(table["_text"])
    make, words, pairs, bounds, total = Tokens(), [np.array([BEGIN])], [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for i, j in steps(offsets, STEP):
        own, _, both, edges = make(raw, offsets[i : j + 1])
        words.append(own)
        pairs.append(both >> U64(64 - bits))
        bounds.append(edges[1:] + total)
        total += len(own)
    bounds = np.concatenate(bounds)
    return np.concatenate(words), np.concatenate(pairs), bounds, bounds[:-1]


def _ask(bits: int, bucket_bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        words, pairs = map(distinct, _asked(table, bits)[:2])
        w, p = bucket_edges(words, 64, bucket_bits), bucket_edges(pairs, bits, bucket_bits)
        give_back()
        rows = [(b, key[0].as_py(), pack_sorted(words[w[b] : w[b + 1]]), pack_sorted(pairs[p[b] : p[b + 1]])) for b in range(1 << bucket_bits) if w[b] < w[b + 1] or p[b] < p[b + 1]]
        return _table(rows, ["bucket", "block", "words", "pairs"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _tell(model: FilterModel, bits: int):
    """The exact counts and the levels of the words, and the levels of the pairs, that each block asked one bucket for, in the order asked."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows, read = [], None
        if known.num_rows and asked.num_rows:
            values, counts = unpack_sorted(known["blob"][0].as_py()), unpack_fixed(known["counts"][0].as_py())
            data = np.frombuffer(known["bits"][0].as_py(), np.uint8)
            read = Filter(data, 8 * len(data), bits, 0, model)
        for lo in range(0, asked.num_rows, ASKED):
            part = asked.slice(lo, ASKED)
            words, pairs = ([unpack_sorted(b) for b in part[c].to_pylist()] for c in ("words", "pairs"))
            all_words, all_pairs = np.concatenate(words), np.concatenate(pairs)
            exact, held, seen = np.zeros(len(all_words), U64), np.zeros(len(all_words), np.uint16), np.zeros(len(all_pairs), np.uint16)
            if read:
                held, seen = read.levels(all_words, 0).astype(np.uint16), read.levels(all_pairs, 1).astype(np.uint16)
                if len(values):
                    at = np.searchsorted(values, all_words)
                    at[at == len(values)] = 0
                    exact = np.where(values[at] == all_words, counts[at], U64(0))
            w, p = (np.cumsum([0, *map(len, x)]).tolist() for x in (words, pairs))
            for i, (block, bucket) in enumerate(zip(part["block"].to_pylist(), part["bucket"].to_pylist())):
                rows.append((block, bucket, pack_fixed(exact[w[i] : w[i + 1]]), held[w[i] : w[i + 1]].tobytes(), seen[p[i] : p[i + 1]].tobytes()))
        give_back()
        return _table(rows, ["block", "bucket", "exact", "held", "seen"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _score(model: FilterModel, bits: int, tokens: int, distinct_words: int):
    edges = np.concatenate(([0.0], levels(model.spacing)))

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, found = in_order(docs), found.sort_by("bucket")
        words, pairs, bounds, starts = _asked(docs, bits)
        # as the block has asked: the answers are in this order
        values, at = ranked(words)
        keys, pair_at = ranked(pairs)
        exact = np.concatenate([unpack_fixed(b) for b in found["exact"].to_pylist()]).astype(np.int64)
        held = edges[np.frombuffer(b"".join(found["held"].to_pylist()), np.uint16)]
        seen = edges[np.frombuffer(b"".join(found["seen"].to_pylist()), np.uint16)]
        if not len(exact) == len(held) == len(values) or len(seen) != len(keys):
            raise ValueError("answers do not match what the block asked for")
        begin, at, size = held[at[0]], at[1:], tokens + distinct_words + 1
        base_of, single_of = np.log10((exact + 1.0) / size), (held + 1) / size
        word = held[at]
        context = np.empty(len(word))
        context[1:] = word[:-1]
        context[starts] = begin
        together = np.minimum(seen[pair_at], np.minimum(word, context))
        single = single_of[at]
        p = np.where(context > 0, model.pair_weight * together / np.maximum(context, 1) + (1 - model.pair_weight) * single, single)
        n, n_known = np.diff(bounds), np.add.reduceat((exact > 0)[at].astype(np.int64), starts)
        base, score = np.add.reduceat(base_of[at], starts), np.add.reduceat(np.log10(p), starts)
        row = docs["_row"].combine_chunks() if isinstance(docs["_row"], pa.ChunkedArray) else docs["_row"]
        give_back()
        return pa.Table.from_arrays([row, pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score)], ["_row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, training: DataFrame, *columns: str, model: FilterModel = FilterModel()) -> DataFrame:
    """The named columns of docs, n_tokens, n_known, train_tokens, base_score and score of each text.

    docs has doc_id (whole numbers) and text; training has text. Words are what ASCII white
    space divides, with A-Z in lower case, and each text has an end, which is a token. Null and
    empty texts are an end alone. Without training texts every count is 0. Equal rows count as
    often as they stand there. Other columns do not matter, whatever their names.
    """
    count = block_count(docs)
    bucket_bits = min(14, max(2, math.ceil(math.log2(count))))
    bits = model.pair_bits
    source = training.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    sent = source.mapInArrow(_count_part(model, bits, bucket_bits), "bucket int, kind int, blob binary, counts binary")
    filled = saved(sent.groupBy("bucket").applyInArrow(_fill(model), "bucket int, blob binary, counts binary, bits binary, distinct long, tokens long"), "lm-counts")
    totals = filled.agg(F.sum("tokens"), F.sum("distinct")).first()
    blocks = blocked(docs, count, list(columns))
    asked = blocks.groupBy("_block").applyInArrow(_ask(bits, bucket_bits), "bucket int, block int, words binary, pairs binary")
    told = asked.groupBy("bucket").cogroup(filled.select("bucket", "blob", "counts", "bits").groupBy("bucket")).applyInArrow(_tell(model, bits), "block int, bucket int, exact binary, held binary, seen binary")
    done = blocks.groupBy("_block").cogroup(told.groupBy("block")).applyInArrow(_score(model, bits, totals[0] or 0, totals[1] or 0), widened(blocks, ["_row"], "n_tokens long, n_known long, base_score double, score double"))
    return done.select("_row.*", "n_tokens", "n_known", F.lit(totals[0] or 0).cast("long").alias("train_tokens"), "base_score", "score")
