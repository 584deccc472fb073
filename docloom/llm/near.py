"""Near-duplicate detection with SetSketch registers.

A register is the truncated, exponentially spaced minimum floor(1 - log_b min x) of one
exponential variable per shingle: registers of a union are the larger ones, and two sets share
a register with about their Jaccard similarity. Documents with equal shingle sets are one node.
Bands of registers deal nodes to buckets. Pairs of a bucket whose likelihood, given both sets'
sizes and the counts of larger, smaller and equal registers, rises towards similarities under the
cut are dropped; what remains is verified on the full sets.

No bucket is expanded into all its pairs. First each node meets the best of its buckets' first
nodes; verified links merge nodes to classes. Buckets that still hold several classes are looked
at again: the registers show which of their nodes have a likely partner of another class (a pair
counts in the first band that it shares), and the full sets of those meet inside the bucket, where
only verified links between classes leave it. A large bucket is cut into chunks, which meet two by two. So no link
between two classes is lost, but for what the bands miss: with 30 bands of 4 registers a pair
at 0.8 with probability 2e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import relabel
from .core import MUL_A, MUL_C, U64, PrefixHash, WordHasher, binary_rows, boxed, buffers, give_back, mix, pack_sorted, ranked, saved, steps, unpack_sorted

STEP = 1 << 18


@dataclass(frozen=True)
class NearRule:
    words: int = 5  # of a shingle
    percent: int = 80  # smallest similarity of a link
    bands: int = 30
    rows: int = 4
    registers: int = 120  # the first bands * rows are banded, all are compared
    base: float = 1.001  # spacing of the registers
    rate: float = 20.0  # of the exponential variables
    deviations: float = 5.0  # how far under the threshold the likelihood must lie for a pair to be dropped
    chunk: int = 4000  # nodes of a bucket that meet in one task

    @property
    def cut(self) -> float:
        j = self.percent / 100
        return max(0.05, j - self.deviations * math.sqrt(j * (1 - j) / self.registers))


class Sets:
    """Shingle sets of many texts: sorted distinct hashes, and where each text's begin."""

    def __init__(self, words: int) -> None:
        self.k, self.hasher, self.rolling = words, WordHasher(lower=True), PrefixHash(0xD1342543DE82EF95)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets one after another, and their n + 1 bounds."""
        hashes, _, _, edges = self.hasher(raw, offsets)
        sums = self.rolling.sums(hashes)
        words = np.diff(edges)
        at = np.arange(len(hashes))
        ends = np.repeat(edges[1:], words)
        whole = at + self.k <= ends
        at = at[whole | ((words < self.k) & (words > 0)).repeat(words) & (at == np.repeat(edges[:-1], words))]  # fewer words than a shingle: the whole sequence is one
        until = np.minimum(at + self.k, ends[at])
        size = until - at
        rolled = self.rolling.spans(sums, at, until)
        flat = mix(np.where(size == self.k, rolled, rolled + size.astype(U64) * MUL_C))
        count = np.where(words >= self.k, words - self.k + 1, (words > 0).astype(np.int64))
        bounds = np.concatenate(([0], np.cumsum(count)))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo > 1:
                flat[lo:hi].sort()
        new = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=new[1:])
        new[bounds[:-1][bounds[:-1] < len(flat)]] = True
        return flat[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def sketch(flat: np.ndarray, starts: np.ndarray, rule: NearRule) -> np.ndarray:
    """The registers of non-empty sets, which stand one after another, one row each."""
    odd = mix(np.arange(1, rule.registers + 1, dtype=U64) * MUL_A) | U64(1)
    least = np.empty((rule.registers, len(starts)), U64)
    work = np.empty(len(flat), U64)
    for i, o in enumerate(odd):
        np.multiply(flat, o, out=work)
        least[i] = np.minimum.reduceat(work, starts)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / rule.rate
    return np.clip(np.floor(1 - np.log(x) / math.log(rule.base)), 0, 65535).astype(np.uint16)


def likely(own: np.ndarray, n_own: np.ndarray, other: np.ndarray, n_other: np.ndarray, rule: NearRule) -> np.ndarray:
    """The slope of each pair's log-likelihood in the similarity, at the cut: not negative where the estimate is at the cut or above."""
    own, other = own.astype(np.int32), other.astype(np.int32)
    larger, smaller = (own > other).sum(-1), (own < other).sum(-1)
    equal = rule.registers - larger - smaller
    u = n_own / (n_own + n_other)
    v = 1 - u
    j = np.minimum(rule.cut, np.minimum(u / v, v / u) * 0.999999)
    c = (rule.base - 1) / rule.base
    log_b = math.log(rule.base)
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p, q = -np.log1p(-c * x) / log_b, -np.log1p(-c * y) / log_b
    dp, dq = c / (1 - c * x) / log_b, c / (1 - c * y) / log_b
    return equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) - larger * v * dp / p - smaller * u * dq / q


def _sketch_part(rule: NearRule, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sets(rule.words)
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            for i, j in steps(offsets, STEP):
                flat, bounds = make(raw, offsets[i : j + 1])
                sizes = np.diff(bounds)
                none = sizes == 0
                starts = bounds[:-1][~none]
                digest = np.zeros((len(starts), 2), U64)
                if len(starts):
                    digest[:, 0], digest[:, 1] = np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ MUL_C), starts)
                nodes = binary_rows(digest.astype(">u8"), np.where(none, 0, 16), none)
                if with_sets:
                    made = pa.array([pack_sorted(flat[lo:hi]) if lo < hi else None for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
                else:
                    registers = sketch(flat, starts, rule) if len(starts) else np.zeros((0, rule.registers), np.uint16)
                    made = binary_rows(registers, np.where(none, 0, 2 * rule.registers), none)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("_id", "_hash")), nodes, pa.array(sizes), made], ["id", "hash", "node", "n", "sets" if with_sets else "registers"])
        give_back()

    return run


def _bands_part(rule: NearRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, rule.registers)[:, : rule.bands * rule.rows].reshape(-1, rule.bands, rule.rows)
            key = np.broadcast_to(mix(np.arange(1, rule.bands + 1, dtype=U64)), registers.shape[:2]).copy()
            for i in range(rule.rows):
                key = mix(key * MUL_A + registers[:, :, i].astype(U64))
            take = pa.array(np.repeat(np.arange(batch.num_rows), rule.bands))
            number = pa.array(np.tile(np.arange(rule.bands, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), number, batch.column("node").take(take)], ["band", "number", "node"])

    return run


def _likely_part(rule: NearRule):
    """Pairs (a, b) whose likelihood passes, with its slope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb")]
            n = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            slope = likely(regs[0], n[0], regs[1], n[1], rule)
            pick = pa.array((slope >= 0) & (100 * np.minimum(*n) >= rule.percent * np.maximum(*n)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pick), batch.column("b").filter(pick), pa.array(slope).filter(pick)], ["a", "b", "slope"])

    return run


def _active(rule: NearRule):
    """The rows of one bucket that have a likely partner of another class, unless an earlier band has shown the pair."""

    def run(table: pa.Table) -> pa.Table:
        numbers = {x: i for i, x in enumerate(dict.fromkeys(table["label"].to_pylist()))}
        label = np.array([numbers[x] for x in table["label"].to_pylist()])
        regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(label), -1)
        n = table["n"].to_numpy().astype(float)
        banded = regs[:, : rule.bands * rule.rows].reshape(len(label), rule.bands, rule.rows)
        here = table["number"][0].as_py()
        largest = np.bincount(label).argmax()  # its rows are only ever the other side
        active = np.zeros(len(label), bool)
        for i in np.flatnonzero(label != largest).tolist():
            j = np.flatnonzero((label != label[i]) & (100 * np.minimum(n, n[i]) >= rule.percent * np.maximum(n, n[i])))
            if len(j):
                j = j[likely(regs[i][None, :], n[i], regs[j], n[j], rule) >= 0]
                j = j[(banded[j, :here] == banded[i, :here]).all(-1).sum(-1) == 0] if here else j
                active[j] = True
                active[i] |= len(j) > 0
        return table.filter(pa.array(active)).select(["band", "low", "high", "node", "label"])

    return run


def _links(rule: NearRule):
    """Verified links that join the classes of one bucket's rows, from their full sets."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pylist()
        numbers = {x: i for i, x in enumerate(dict.fromkeys(table["label"].to_pylist()))}
        label = np.array([numbers[x] for x in table["label"].to_pylist()])
        sets = [unpack_sorted(b) for b in table["sets"].to_pylist()]
        size = np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        values, ids = ranked(np.concatenate(sets))
        mark = np.zeros(len(values), np.int64)
        out = []
        for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
            own = ids[starts[i] : starts[i] + size[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            for j in np.flatnonzero((100 * shared >= rule.percent * (size + size[i] - shared)) & (label != label[i])).tolist():
                if label[j] != label[i]:  # not joined by a link just found
                    out.append((nodes[i], nodes[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _verify_part(rule: NearRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, other = None, None
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = x.as_py(), y.as_py()
                if y != last:
                    last, other = y, unpack_sorted(y)
                own = unpack_sorted(x)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * shared >= rule.percent * (len(own) + len(other) - shared))
            pick = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pick), batch.column("b").filter(pick)], ["a", "b"])

    return run


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def classes(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """id, hash (of the text), n_shingles, label (the class; null without words) and component_id for each row of docs."""
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), _text_hash().alias("_hash"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    rows = saved(source.mapInArrow(_sketch_part(rule, False), "id long, hash long, node binary, n long, registers binary"), "near-rows")
    # a set's digest names it; its number, which is final once it is written, is what the rounds below carry
    each = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = saved(each.select(F.col("node").alias("digest"), F.monotonically_increasing_id().alias("node"), "id", "n", "registers"), "near-nodes")
    facts = nodes.select("node", "n", "registers")
    bands = facts.mapInArrow(_bands_part(rule), "band long, number int, node long")
    shared = bands.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    bands = saved(bands.join(shared, "band"), "near-bands")
    side = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    stars = bands.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    likely_stars = stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely_part(rule), "a long, b long, slope double")
    best = saved(likely_stars.groupBy("a").agg(F.max_by("b", F.struct("slope", "b")).alias("b")), "near-stars")
    # full sets are needed only of nodes that share a bucket, and of each only from its first document
    wanted = bands.select("node").distinct()
    named = nodes.join(wanted, "node", "left_semi").select("digest", "node", F.col("id").alias("_first"))
    own = source.mapInArrow(_sketch_part(rule, True), "id long, hash long, node binary, n long, sets binary").select("id", F.col("node").alias("digest"), "sets")
    sets = saved(own.join(named, "digest").where(F.col("id").eqNullSafe(F.col("_first"))).select("node", "sets").dropDuplicates(["node"]), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("sets").alias("sa")), "a")
        return with_a.join(sets.select(F.col("node").alias("b"), F.col("sets").alias("sb")), "b").mapInArrow(_verify_part(rule), "a long, b long")

    labels = relabel(wanted.select("node", F.col("node").alias("label")), verified(best))
    held = bands.join(labels, "node")
    several = held.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    chunks = F.ceil(F.col("size") / F.lit(float(rule.chunk)))
    chunked = held.join(several, "band").join(facts, "node").withColumn("own", F.pmod(F.xxhash64("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    chunked = chunked.select("band", F.least("own", "other").cast("int").alias("low"), F.greatest("own", "other").cast("int").alias("high"), "number", "node", "label", "n", "registers")
    active = chunked.groupBy("band", "low", "high").applyInArrow(_active(rule), "band long, low int, high int, node long, label long")
    links = active.join(sets, "node").groupBy("band", "low", "high").applyInArrow(_links(rule), "a long, b long")
    labels = relabel(labels, links.distinct())
    labelled = nodes.select("digest", "node", "id").join(labels, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    told = labelled.join(smallest, "label").select(F.col("digest").alias("node"), "label", "component_id")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.select("id", "hash", "node", "n").join(told, "node", "left").select("id", "hash", F.col("n").alias("n_shingles"), "label", component)


def components(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """id (doc_id), n_shingles and component_id (the smallest doc_id of the document's class), for each row of docs.

    Words are what ASCII white space divides, with A-Z in lower case; a text of fewer words
    than a shingle is one shingle; a text without words, or null, is linked with nothing. Rows
    with equal sets are linked, whether their ids or texts repeat or not. A null doc_id is never
    the smallest, unless its class has no other. Other columns of docs do not matter.
    """
    return classes(docs, rule).select("id", "n_shingles", "component_id")


def keep(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """One row of each class, that of the smallest doc_id (null last; then of the text's hash), with docs' columns.

    Rows without words are linked with nothing, and stay. Rows of one doc_id with texts of different classes stay too;
    of rows that repeat the doc_id and the text that a class keeps, one does.
    """
    found = saved(classes(docs, rule).where("label is not null").select("id", "hash", "label"), "near-found")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.hash").alias("_hash"))
    own = boxed(docs, "doc_id", "text").withColumn("_own", _text_hash())
    spoken = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = own.where(spoken).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi")
    if not found.groupBy("id", "hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_own"])
    return kept.unionByName(own.where(~spoken)).select("_boxed.*")
