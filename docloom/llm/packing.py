"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

A document longer than the capacity is cut into full pieces, which fill bins of their own,
and a rest. Rests are placed longest first, each into the tightest open bin that has room and
holds neither its source nor its duplicate cluster; where no bin is compatible a new one opens.

Open bins are ordered by residual. A tree over the residuals keeps, for each range, the
labels that *every* bin of it carries; the successor search descends only where some bin may
be compatible, and goes on to the next residual until it finds one. A bin's labels are a bitmap for the
labels that are frequent in a shard, and a set for the others.

Shards are packed on their own: rests are dealt to shards of about `shard_rows` rows by a hash, so
one shard fits a task, however many documents there are and whatever their sources.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import widened
from .near import NearRule, components


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048  # words of a sequence
    shard_rows: int = 8_000
    frequent: int = 16  # rows of a shard from which a label has a bit


class OpenBins:
    """Bins by residual, with a tree of the labels common to all bins of a range of residuals."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.width)  # -1: no bin, so every label blocks
        self.bins: dict[int, dict[int, dict[int, frozenset]]] = {}  # residual: bitmap: bin: rare labels

    def _update(self, residual: int) -> None:
        masks = self.bins.get(residual)
        value = -1
        for mask in masks or ():
            value &= mask
        at = residual + self.width
        while at and self.common[at] != value:
            self.common[at] = value
            at >>= 1
            if at:
                value = self.common[2 * at] & self.common[2 * at + 1]

    def add(self, residual: int, mask: int, number: int, rare: frozenset) -> None:
        masks = self.bins.setdefault(residual, {})
        fresh = mask not in masks
        masks.setdefault(mask, {})[number] = rare
        if fresh:
            self._update(residual)

    def remove(self, residual: int, mask: int, number: int) -> None:
        masks = self.bins[residual]
        del masks[mask][number]
        if not masks[mask]:
            del masks[mask]
            if not masks:
                del self.bins[residual]
            self._update(residual)

    def successor(self, size: int, mask: int) -> int | None:
        """The smallest residual from size on where some bin carries none of the frequent labels in mask, as far as the tree tells."""
        at = size + self.width
        if not self.common[at] & mask:
            return size
        while at > 1:
            if not at & 1 and not self.common[at + 1] & mask:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.width:
            at *= 2
            if self.common[at] & mask:
                at += 1
        return at - self.width

    def tightest(self, size: int, mask: int, rare: frozenset) -> tuple[int, int, int] | None:
        """(residual, bitmap, bin) of the tightest compatible bin; of equally tight ones, the first that reached this residual under its labels."""
        while size < self.width and (residual := self.successor(size, mask)) is not None:
            for held, bins in self.bins.get(residual, {}).items():
                if not held & mask:
                    for number, labels in bins.items():
                        if not labels & rare:
                            return residual, held, number
            size = residual + 1
        return None


def pack(rests: Iterable[tuple[int, object, object]], rule: Packing = Packing()) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, source, cluster), in the order given; None labels conflict with nothing."""
    rests = list(rests)
    labels = [[(0, s)] * (s is not None) + [(1, c)] * (c is not None) for _, s, c in rests]
    counts = Counter(x for own in labels for x in own)
    bits = {x: 1 << i for i, x in enumerate(sorted((x for x, n in counts.items() if n >= rule.frequent), key=lambda x: (-counts[x], x[0], str(x[1]))))}
    open_bins, placed, bins = OpenBins(rule.capacity), [(-1, -1)] * len(rests), 0
    for i in sorted(range(len(rests)), key=lambda i: -rests[i][0]):
        size = rests[i][0]
        mask = sum(bits.get(x, 0) for x in labels[i])
        rare = frozenset(x for x in labels[i] if x not in bits and counts[x] > 1)
        found = open_bins.tightest(size, mask, rare) if size else None
        if found:
            residual, held, number = found
            had = open_bins.bins[residual][held][number]
            open_bins.remove(residual, held, number)
        else:
            residual, held, number, had = rule.capacity, 0, bins, frozenset()
            bins += 1
        placed[i] = (number, rule.capacity - residual)
        if residual > size:
            open_bins.add(residual - size, held | mask, number, had | rare)
    return placed


def _count_part(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len((t.as_py() or b"").split()) for t in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [sizes], [*names, "_size"])

    return run


def _pack_part(rule: Packing):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_size", "descending"), ("_order", "ascending")])
        sizes = table["_size"].to_pylist()
        rests = [size % rule.capacity for size in sizes]
        led = [i for i, rest in enumerate(rests) if rest]
        sources, clusters = table["_source"].to_pylist(), table["_cluster"].to_pylist()
        placed = pack(((rests[i], sources[i], clusters[i]) for i in led), rule)
        rows = [(i, sizes[i] // rule.capacity, rests[i], number, offset) for i, (number, offset) in zip(led, placed)]
        number = max((p[0] for p in placed), default=-1)
        for i, size in enumerate(sizes):  # full pieces have bins of their own, after the others
            for piece in range(size // rule.capacity):
                number += 1
                rows.append((i, piece, rule.capacity, number, 0))
        shard = key[0].as_py()
        own = table.take(pa.array([r[0] for r in rows], pa.int64()))
        made = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)] + [pa.array([f"{shard}-{r[3]}" for r in rows]), pa.array([r[4] for r in rows], pa.int64())]
        return pa.Table.from_arrays([own["doc_id"], own["source"], *made], ["doc_id", "source", "piece", "n_tokens", "bin", "offset"])

    return run


def assign(docs: DataFrame, rule: Packing = Packing(), cluster: str | None = None, near: NearRule | None = None) -> DataFrame:
    """doc_id, source, piece, n_tokens, bin and offset of each piece of each document.

    docs has doc_id, text and source; `cluster` names a column of duplicate-cluster ids, or else `near`
    is the rule whose near-duplicate classes are the clusters. Without
    either, texts that are equal but for ASCII case and white space are a cluster. Bins are named
    shard-number. Texts without words, and nulls, have no piece. A null
    source or cluster conflicts with nothing; equal rows are placed one by one. Other columns
    do not matter, whatever their names.
    """
    order = F.xxhash64("doc_id", "source", "text")
    parts = [F.col("doc_id"), F.col("source"), order.alias("_order")]
    if cluster:
        parts.append(F.col(cluster).cast("string").alias("_cluster"))
    elif not near:
        lowered = F.translate(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), ascii_uppercase, ascii_lowercase)
        parts.append(F.xxhash64(lowered).cast("string").alias("_cluster"))
    own = docs.select(*parts)
    source = docs.select(*parts, F.col("text").cast("binary").alias("_text"))
    sized = source.mapInArrow(_count_part(own.columns), widened(own, own.columns, "_size long")).where("_size > 0")
    if near and not cluster:  # by the hash of the whole row, as ids may repeat; the texts stay where they are
        classes = components(docs.select(order.alias("doc_id"), "text"), near).groupBy(F.col("id").alias("_order")).agg(F.min("component_id").cast("string").alias("_cluster"))
        sized = sized.join(classes, "_order", "left")
    shards = max(1, math.ceil(docs.count() / rule.shard_rows))
    dealt = sized.withColumn("_shard", F.pmod(F.xxhash64("_order", F.lit(7)), F.lit(shards))).withColumn("_source", F.col("source").cast("string"))
    return dealt.groupBy("_shard").applyInArrow(_pack_part(rule), widened(own, ["doc_id", "source"], "piece long, n_tokens long, bin string, offset long"))
