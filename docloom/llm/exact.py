"""Removal of repeated byte strings by suffix arrays.

A string of `length` bytes that starts twice anywhere is removed wherever it stands; strings of
`passage` bytes, where that is less, are marked too. Suffix-array shards decide which strings do: they sort the
bytes by induced sorting (suffixes.py), and two suffixes next to each other in an array whose
permuted common prefix reaches a string's end are a repeated string.

Each string has a content-defined anchor among its first bytes (anchors.py), whose `context`
bytes to the right lie in the string too. The starts of one anchor, with all bytes of their strings, are
a piece, so each start is in one piece. Blocks of documents count the hashes of contexts in packed
buckets; pieces whose context stands once hold no repeated string. All others go to the shard that their
context names, a block's equal pieces as one. There what a cryptographic digest tells to be one
is one symbol: the context, between the bytes to its left and those to its right, or the whole
piece where all pieces of a context agree. So equal strings meet in one shard, and are equal there.
Repeated starts go back to the blocks, which mark the bytes.

A context that very many different pieces share (a common line, with whatever stands around it)
would crowd its shard. Blocks count the hashes of the whole strings of such pieces first, and
send on only the stretches whose strings stand twice, so that what is alike in all of them arrives as one.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import K, anchors
from .blocks import answers, block_count, blocked, bucket_edges, in_order, member
from .core import MUL_A, MUL_B, MUL_C, U64, PrefixHash, boxed, buffers, give_back, mix, pack_sorted, runs_of, steps, unpack_sorted, widened
from .substring import _table
from .suffixes import permuted_prefixes, suffix_array

STEP = 1 << 18
CROWD = 1 << 14  # different pieces of a context, summed over blocks, from which their strings are counted first
#: Bits of the hashes that choose what is sorted. Different contexts or strings of one hash only add to what the arrays compare.
CONTEXT_BITS, STRING_BITS, PIECE_BITS = 48, 40, 40
AGREED, SHARED, CROWDED = range(3)  # contexts
STRINGS, WHOLE, LONG, SHORT = range(4)  # kinds of what blocks are told: of strings, and of starts
_TOLD = "block int, kind int, blob binary, masks binary"
_TOLD_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_BOTH, _AS_ONE, _SHORT, _LONG = range(4)  # kinds of pieces: with all strings of an anchor, as read and as one symbol; with those of either length


@dataclass(frozen=True)
class Lengths:
    """Of the strings that are removed, of the shorter ones that are marked, and what follows from that."""

    length: int
    passage: int

    @property
    def width(self) -> int:
        """Of an anchor's window."""
        return max(K, self.passage * 4 // 15)

    def of(self, kind: int) -> int:
        """The length of the strings that a piece of this kind is for."""
        return self.length if kind == _LONG else self.passage

    def context(self, kind: int) -> int:
        """The bytes from an anchor on that all of the anchor's strings hold."""
        return self.of(kind) - self.width + 1

    @property
    def kinds(self) -> tuple[int, ...]:
        return (_LONG,) if self.passage == self.length else (_SHORT, _LONG)


class Pieces:
    """Pieces of some texts: anchor, first and last start and end of each, and the hash of its context."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, sizes: Lengths, one: PrefixHash, two: PrefixHash) -> None:
        self.base, self.sizes, self.one, self.two = int(offsets[0]), sizes, one, two
        self.values = raw[self.base : int(offsets[-1])].astype(U64) + U64(1)
        self.sums, self.lazy = one.sums(self.values), {}  # shared by the pieces chosen from these
        at, first, last = anchors(self.sums, one, sizes.width)
        bounds = offsets - self.base
        doc = np.searchsorted(bounds, at, side="right") - 1
        self.at, self.ends = at, bounds[doc + 1]
        self.first, self.last = np.maximum(first, bounds[doc]), np.minimum(last, self.ends - sizes.passage)
        self.stop = np.minimum(self.last + sizes.length, self.ends)
        self.kind = _BOTH
        self._keep(np.flatnonzero(self.first <= self.last))
        self.context = mix(one.spans(self.sums, self.at, self.at + sizes.context(_SHORT))) >> U64(64 - CONTEXT_BITS)

    def _keep(self, pick: np.ndarray) -> None:
        self.at, self.first, self.last, self.stop, self.ends = (x[pick] for x in (self.at, self.first, self.last, self.stop, self.ends))

    def some(self, pick: np.ndarray, kind: int = _BOTH) -> Pieces:
        """The chosen pieces, as a kind."""
        out = object.__new__(Pieces)
        out.__dict__.update(self.__dict__)
        out._keep(pick)
        out.context, out.kind = self.context[pick], kind
        if kind in (_SHORT, _LONG):
            out.last = np.minimum(out.last, out.ends - self.sizes.of(kind))
            out.stop = out.last + self.sizes.of(kind)
            enough = np.flatnonzero(out.first <= out.last)
            out._keep(enough)
            out.context = out.context[enough]
        return out

    def keys(self) -> np.ndarray:
        """The hash of each piece's bytes, by two bases, and of its kind."""
        if not self.lazy:
            self.lazy["second"] = self.two.sums(self.values)
        size = (self.stop - self.first).astype(U64)
        one = mix(self.one.spans(self.sums, self.first, self.stop) + size * MUL_B)
        return mix(one ^ (self.two.spans(self.lazy["second"], self.first, self.stop) + size * MUL_A + U64(self.kind)))

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece, the start and the hash of each string."""
        count = self.last - self.first + 1
        piece = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count - self.first, count)
        return piece, start, mix(self.one.spans(self.sums, start, start + self.sizes.of(self.kind)) + U64(self.kind) * MUL_C) >> U64(64 - STRING_BITS)

    def stretches(self, known: np.ndarray) -> Pieces:
        """The pieces cut to stretches of starts whose strings' hashes are known."""
        piece, start, hashes = self.strings()
        hit = member(hashes, known)
        piece, start = piece[hit], start[hit]
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(piece))[: len(head)] - 1
        out = object.__new__(Pieces)
        out.__dict__.update(self.__dict__)
        out._keep(piece[head])
        out.context = self.context[piece[head]]
        out.first, out.last, out.stop = start[head], start[tail], start[tail] + self.sizes.of(self.kind)
        return out


def _each(raw: np.ndarray, offsets: np.ndarray, sizes: Lengths) -> Iterator[Pieces]:
    one, two = PrefixHash(), PrefixHash(0x9FB21C651E98DF25)
    for i, j in steps(offsets, STEP):
        if offsets[j] - offsets[i] >= sizes.passage:
            yield Pieces(raw, offsets[i : j + 1], sizes, one, two)


def _told(found: pa.Table, kind: int) -> pa.Table:
    return found.filter(pc.equal(found["kind"], kind))


def _starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _contexts(sizes: Lengths, bucket_bits: int):
    """What each block sends to the buckets: its distinct contexts, and of each how many different pieces it has, whether it stands twice, and a piece's hash."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        raw, offsets = buffers(table["_text"])
        parts = [(p.context, p.keys()) for p in _each(raw, offsets, sizes)]
        context, piece = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U64),) * 2
        by = np.lexsort((piece, context))
        context, piece = context[by], piece[by]
        start = _starts_of(context)
        told = np.zeros(0, U64)
        if len(start):
            other = np.zeros(len(by), np.int64)
            other[start] = 1
            other[1:] |= piece[1:] != piece[:-1]
            different = np.minimum(8 * np.log2(np.add.reduceat(other, start)), 127).astype(U64)  # on a logarithmic scale
            told = piece[start] >> U64(64 - PIECE_BITS) << U64(8) | different << U64(1) | (np.diff(np.append(start, len(by))) > 1).astype(U64)
        context, told = context[start], told.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PIECE_BITS // 8 + 1]
        edges = bucket_edges(context, CONTEXT_BITS, bucket_bits).tolist()
        rows = [(b, key[0].as_py(), pack_sorted(context[lo:hi]), told[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if lo < hi]
        give_back()
        return _table(rows, ["bucket", "block", "blob", "told"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _groups(crowd: int):
    """For each block of one bucket, its contexts that stand twice: those whose pieces all agree, others, and those of very many pieces."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        lists = [unpack_sorted(b) for b in table["blob"].to_pylist()]
        context = np.concatenate(lists)
        wide = np.zeros((len(context), 8), np.uint8)
        wide[:, : PIECE_BITS // 8 + 1] = np.frombuffer(b"".join(table["told"].to_pylist()), np.uint8).reshape(len(context), -1)
        told = wide.reshape(-1).view("<u8")
        by = np.argsort(context, kind="stable")
        context, told = context[by], told[by]
        start = _starts_of(context)
        piece, scale = told >> U64(8), (told >> U64(1) & U64(127)).astype(np.int64)
        twice = (np.diff(np.append(start, len(by))) > 1) | np.bitwise_or.reduceat(told & U64(1), start).astype(bool)
        different = np.add.reduceat(2.0 ** (scale / 8), start)
        agreed = (np.maximum.reduceat(scale, start) == 0) & (np.minimum.reduceat(piece, start) == np.maximum.reduceat(piece, start))
        known, kind = context[start[twice]], np.where(agreed, AGREED, np.where(different <= crowd, SHARED, CROWDED))[twice]
        rows = []
        for block, own in zip(blocks, lists):
            own = own[member(own, known)]
            if len(own):
                which = kind[np.searchsorted(known, own)]
                rows.append((block, *(pack_sorted(own[which == k]) if (which == k).any() else None for k in (AGREED, SHARED, CROWDED))))
        return _table(rows, ["block", "agreed", "shared", "crowded"], [pa.int32(), *[pa.binary()] * 3])

    return run


def _pieces_of(p: Pieces, contexts: np.ndarray) -> list[Pieces]:
    """The pieces of these contexts, for strings of each length."""
    own = np.flatnonzero(member(p.context, contexts))
    return [q for kind in p.sizes.kinds if len((q := p.some(own, kind)).at)] if len(own) else []


def _strings(sizes: Lengths, bucket_bits: int):
    """The distinct string hashes of a block's crowded pieces, and those that stand twice in the block."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        crowded, rows = answers(found.filter(pc.is_valid(found["crowded"])), "crowded"), []
        if len(crowded):
            raw, offsets = buffers(docs["_text"])
            parts = [np.zeros(0, U64)] + [q.strings()[2] for p in _each(raw, offsets, sizes) for q in _pieces_of(p, crowded)]
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            twice = values[counts > 1]
            edges, more = (bucket_edges(x, STRING_BITS, bucket_bits).tolist() for x in (values, twice))
            rows = [(b, key[0].as_py(), pack_sorted(values[edges[b] : edges[b + 1]]), pack_sorted(twice[more[b] : more[b + 1]])) for b in range(1 << bucket_bits) if edges[b] < edges[b + 1]]
        give_back()
        return _table(rows, ["bucket", "block", "blob", "again"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _repeated_strings(table: pa.Table) -> pa.Table:
    blocks = table["block"].to_pylist()
    lists = [unpack_sorted(b) for b in table["blob"].to_pylist()]
    every = np.sort(np.concatenate(lists + [unpack_sorted(b) for b in table["again"].to_pylist()]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = [(block, STRINGS, pack_sorted(found), None) for block, own in zip(blocks, lists) if len(found := own[member(own, twice)])]
    return _table(rows, ["block", "kind", "blob", "masks"], _TOLD_TYPES)


def _sorted_pieces(raw: np.ndarray, offsets: np.ndarray, sizes: Lengths, found: pa.Table) -> Iterator[Pieces]:
    """The pieces of a block that go to shards."""
    agreed, shared, crowded = (answers(found.filter(pc.is_valid(found[c])), c) for c in ("agreed", "shared", "crowded"))
    strings = answers(_told(found, STRINGS))
    if not len(agreed) and not len(shared) and not len(strings):
        return
    for p in _each(raw, offsets, sizes):
        own = np.flatnonzero(member(p.context, agreed))
        if len(own):
            yield p.some(own, _AS_ONE)
        yield from _pieces_of(p, shared)
        if len(strings):
            yield from (cut for q in _pieces_of(p, crowded) if len((cut := q.stretches(strings)).at))


def _send(sizes: Lengths, shards: int):
    """A block's different pieces, each to the shard of its context: keys, kinds, digests, whether they stand twice, and the bytes to the left and right of the context."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        raw, offsets = buffers(docs["_text"])
        parts = [(p.keys(), p.context, p.at + p.base, p.first + p.base, p.stop + p.base, np.full(len(p.at), p.kind, np.uint8)) for p in _sorted_pieces(raw, offsets, sizes, found)]
        rows = []
        if parts:
            keys, context, middle, first, stop, kind = (np.concatenate(x) for x in zip(*parts))
            keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
            shard = (mix(context[at] + MUL_A) % U64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            keys, at, twice, shard = keys[by], at[by], (counts[by] > 1).astype(np.uint8), shard[by]
            middle, first, stop, kind = (x[at] for x in (middle, first, stop, kind))
            # what is one symbol: all of the piece, or the context
            begin = np.where(kind == _AS_ONE, first, middle)
            end = np.where(kind == _AS_ONE, stop, middle + np.where(kind == _LONG, sizes.context(_LONG), sizes.context(_SHORT)))
            margins = np.stack([begin - first, stop - end], axis=1).astype("<u2")
            edges = np.append(_starts_of(shard), len(shard))
            data = raw.tobytes()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                digests, text = [], []
                for a, b, c, d in zip(first[lo:hi].tolist(), begin[lo:hi].tolist(), end[lo:hi].tolist(), stop[lo:hi].tolist()):
                    digests.append(blake2b(data[b:c], digest_size=16).digest())
                    text += [data[a:b], data[c:d]]
                rows.append((int(shard[lo]), key[0].as_py(), keys[lo:hi].astype("<u8").tobytes(), kind[lo:hi].tobytes(), b"".join(digests), twice[lo:hi].tobytes(), margins[lo:hi].tobytes(), b"".join(text)))
        give_back()
        return _table(rows, ["shard", "block", "keys", "kinds", "digests", "twice", "margins", "text"], [pa.int32(), pa.int32(), *[pa.binary()] * 6])

    return run


def shared_prefixes(pieces: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the distinct pieces' text, the longest prefix that its suffix shares with any other; and where each piece's symbol is.

    A piece is the number of its symbol, and the bytes to the left and to the right of that.
    """
    left, right = (np.array([len(p[k]) for p in pieces], np.int64) for k in (1, 2))
    symbol = np.array([p[0] for p in pieces], np.int64)
    # a place for the symbol after the left bytes, and one for the piece's end
    text = np.frombuffer(b"".join([x for p in pieces for x in (p[1], b"\x00", p[2], b"\x00")]) + b"\x00", np.uint8).astype(np.int32) + 2
    ends = np.cumsum(left + right + 2) - 1
    middle = ends - right - 1
    text[middle] = 258 + symbol
    text[ends] = 1
    text[-1] = 0
    array = suffix_array(text, 259 + int(symbol.max()))
    own = permuted_prefixes(text, array)[array]
    best = np.zeros(len(text), np.int64)
    best[array] = np.maximum(own, np.append(own[1:], 0))
    return best, middle


def repeated_starts(pieces: list[tuple[int, bytes, bytes]], count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A flag for each start of each of the distinct pieces, whether its string stands twice, and the n + 1 bounds of the pieces' flags.

    A piece is the number of its symbol and the bytes on both sides of that; a string is `width`
    symbols, the symbol one of them, and a piece without such bytes has one start. A piece counts as often as `count` says.
    Bytes next to a symbol that all of its pieces share become part of it, so the arrays hold only where pieces differ.
    """
    own: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        own.setdefault(piece[0], []).append(i)
    folded, common = list(pieces), np.zeros((len(pieces), 2), np.int64)
    for symbol, group in own.items():
        before = len(os.path.commonprefix([pieces[i][1][::-1] for i in group]))
        after = len(os.path.commonprefix([pieces[i][2] for i in group]))
        for i in group:
            _, left, right = pieces[i]
            folded[i] = (symbol, left[: len(left) - before], right[after:])
        common[group] = before, after
    best, middle = shared_prefixes(folded)
    left, right = (np.array([len(p[k]) for p in pieces], np.int64) for k in (1, 2))
    starts = np.where(left + right == 0, 1, left + right + 2 - width)
    bounds = np.concatenate(([0], np.cumsum(starts)))
    piece = np.repeat(np.arange(len(pieces)), starts)
    ahead = left[piece] - (np.arange(bounds[-1]) - bounds[piece])  # bytes of the string before the symbol
    behind = np.where((left + right == 0)[piece], 0, width - 1 - ahead)  # and after it
    ahead, behind = np.maximum(0, ahead - common[piece, 0]), np.maximum(0, behind - common[piece, 1])
    return (best[middle[piece] - ahead] >= ahead + 1 + behind) | (count > 1)[piece], bounds


def _shard(sizes: Lengths):
    def run(table: pa.Table) -> pa.Table:
        symbols: dict[tuple[int, bytes], int] = {}
        known: dict[tuple[int, bytes, bytes], int] = {}
        kind_of, owners = [], []
        for kinds, digests, margins, text in zip(*(table[c].to_pylist() for c in ("kinds", "digests", "margins", "text"))):
            own, at = [], 0
            for i, (kind, (left, right)) in enumerate(zip(kinds, np.frombuffer(margins, "<u2").reshape(-1, 2).tolist())):
                symbol = symbols.setdefault((kind, digests[16 * i : 16 * i + 16]), len(symbols))
                end = at + left + right
                number = known.setdefault((symbol, text[at : at + left], text[at + left : end]), len(known))
                if number == len(kind_of):
                    kind_of.append(kind)
                own.append(number)
                at = end
            owners.append(np.array(own, np.int64))
        twice = np.frombuffer(b"".join(table["twice"].to_pylist()), np.uint8)
        count = np.bincount(np.concatenate(owners), weights=1.0 + twice).astype(np.int64)
        hit, bounds = repeated_starts(list(known), count, sizes.width)
        any_hit = np.add.reduceat(hit, bounds[:-1], dtype=np.int64) > 0
        kinds = np.array(kind_of)
        rows = []
        for kind, as_kind in ((WHOLE, _AS_ONE), (SHORT, _SHORT), (LONG, _LONG)):
            told = any_hit & (kinds == as_kind)
            masks = {} if kind == WHOLE else {i: np.packbits(hit[bounds[i] : bounds[i + 1]], bitorder="little").tobytes() for i in np.flatnonzero(told).tolist()}
            for block, own, keys in zip(table["block"].to_pylist(), owners, table["keys"].to_pylist()):
                on = np.flatnonzero(told[own])
                if len(on):
                    rows.append((block, kind, np.frombuffer(keys, "<u8")[on].tobytes(), b"".join([masks[i] for i in own[on].tolist()]) if masks else None))
        give_back()
        return _table(rows, ["block", "kind", "blob", "masks"], _TOLD_TYPES)

    return run


def whole_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The interval without the bytes of code points that it holds in part."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    while start < end and inside(start):
        start += 1
    while end > start and inside(end):
        end -= 1
    return start, end


def _covered(raw: np.ndarray, offsets: np.ndarray, sizes: Lengths, found: pa.Table) -> dict[int, np.ndarray]:
    """For each byte of a block, whether a repeated string of each length covers it."""
    told = {}
    for kind, as_kind in ((WHOLE, _AS_ONE), (SHORT, _SHORT), (LONG, _LONG)):
        rows = _told(found, kind)
        keys = np.frombuffer(b"".join(rows["blob"].to_pylist()), "<u8")
        by = np.argsort(keys)
        told[as_kind] = keys[by], by, b"".join(x or b"" for x in rows["masks"].to_pylist()), []
    edges = {kind: np.zeros(len(raw) + 1, np.int32) for kind in sizes.kinds}
    for p in _sorted_pieces(raw, offsets, sizes, found) if any(len(x[0]) for x in told.values()) else ():
        keys, by, _, parts = told[p.kind]
        if not len(keys):
            continue
        own = p.keys()
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == own)
        first, last, ends = ((x + p.base)[hit] for x in (p.first, p.last, p.ends))
        if p.kind == _AS_ONE:  # all of its strings stand twice
            for kind in sizes.kinds:
                until = np.minimum(last + sizes.of(kind), ends)
                on = until - first >= sizes.of(kind)
                np.add.at(edges[kind], first[on], 1)
                np.add.at(edges[kind], until[on], -1)
        else:
            parts.append((by[at[hit]], first, last - first + 1))
    covered = {}
    for kind in sizes.kinds:
        keys, _, data, parts = told[kind]
        begins = np.zeros(len(raw), bool)
        if parts:
            which, first, count = (np.concatenate(x) for x in zip(*parts))
            size = np.zeros(len(keys), np.int64)
            size[which] = (count + 7) // 8
            places, bits = np.cumsum(size) - size, np.frombuffer(data, np.uint8)
            for lo in range(0, len(which), 1 << 14):
                w, f, c = which[lo : lo + (1 << 14)], first[lo : lo + (1 << 14)], count[lo : lo + (1 << 14)]
                k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                on = bits[np.repeat(places[w], c) + (k >> 3)] >> (k & 7).astype(np.uint8) & 1 == 1
                begins[(np.repeat(f, c) + k)[on]] = True
        run, length = np.cumsum(begins, dtype=np.int32), sizes.of(kind)
        run[length:] -= run[:-length].copy()
        covered[kind] = (run > 0) | (np.cumsum(edges[kind][:-1], dtype=np.int32) > 0)
    return covered


def _mark(sizes: Lengths, characters: bool):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = in_order(docs)
        raw, offsets = buffers(docs["_text"])
        covered = _covered(raw, offsets, sizes, found)
        inside = np.concatenate(([0], np.cumsum(covered[sizes.kinds[0]], dtype=np.int64)))
        told = inside[offsets[1:]] - inside[offsets[:-1]]
        low, high = runs_of(covered[_LONG])
        spans, kept = [], []
        lows, highs = np.searchsorted(high, offsets[:-1], side="right"), np.searchsorted(low, offsets[1:], side="left")
        for i, text in enumerate(docs["_text"]):
            text, base = text.as_py(), int(offsets[i])
            if lows[i] >= highs[i]:
                spans.append([])
                kept.append(text)
                continue
            # adjacent runs of two texts may touch: each is cut to its own
            own = [(max(0, int(a) - base), min(len(text), int(b) - base)) for a, b in zip(low[lows[i] : highs[i]], high[lows[i] : highs[i]])]
            if characters:
                own = [whole_characters(text, *x) for x in own]
            own = [pair for pair in own if pair[0] < pair[1]]  # an empty text may lie inside a run
            spans.append([{"start": a, "end": b} for a, b in own])
            cuts = [0, *(x for pair in own for x in pair), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        row = docs["_row"].combine_chunks() if isinstance(docs["_row"], pa.ChunkedArray) else docs["_row"]
        give_back()
        return pa.Table.from_arrays([row, pa.array(np.diff(offsets), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(told, pa.int64())], ["_row", "n_bytes", "removed", "kept", "n_passage"])

    return run


def clean(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with the repeated strings cut from its texts (in whole characters), and n_chars, where there is one, brought up to date.

    Rows whose whole text is cut stay, with an empty text.
    """
    found = dedup(boxed(docs, "doc_id", "text"), "_boxed", length=length, characters=True)
    text = F.when(F.col("_boxed.text").isNotNull(), F.col("kept").cast("string"))
    updated = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select([updated.get(c, F.col(f"_boxed.`{c}`")).alias(c) for c in docs.columns])


def dedup(docs: DataFrame, *columns: str, length: int = 400, passage: int | None = None, characters: bool = False, crowd: int = CROWD) -> DataFrame:
    """The named columns of docs, n_bytes of the text in UTF-8, removed (maximal byte intervals), kept (the bytes left, binary) and n_passage.

    docs has doc_id (whole numbers) and text. Every copy goes, the first included; strings are
    judged on the input, and never cross documents. Null and empty texts have no bytes; texts
    shorter than `length` stay whole; equal rows repeat one another. Other columns of docs do
    not matter, whatever their names. With `characters`, code points that an
    interval holds in part stay, so that what is kept is still UTF-8. `crowd` changes only the way, not the result.

    n_passage is the number of bytes in strings of `passage` bytes that start twice; `passage` is
    `length` unless it is given, and must be from 64 to `length`.
    """
    sizes = Lengths(length, length if passage is None else passage)
    if not 64 <= sizes.passage <= length:
        raise ValueError("length must be at least 64, and passage from 64 to length")
    count = block_count(docs)
    bucket_bits = min(16, max(2, math.ceil(math.log2(count))))
    blocks = blocked(docs, count, list(columns))
    sent = blocks.groupBy("_block").applyInArrow(_contexts(sizes, bucket_bits), "bucket int, block int, blob binary, told binary")
    groups = sent.groupBy("bucket").applyInArrow(_groups(crowd), "block int, agreed binary, shared binary, crowded binary")
    crowded = groups.where("crowded is not null").select("block", "crowded")
    # an inner join with distinct blocks: a semi-join would be pushed below the exchange of the texts, which would be made again
    strings = blocks.join(crowded.select(F.col("block").alias("_block")).distinct(), "_block").groupBy("_block").cogroup(crowded.groupBy("block"))
    strings = strings.applyInArrow(_strings(sizes, bucket_bits), "bucket int, block int, blob binary, again binary")
    told = groups.unionByName(strings.groupBy("bucket").applyInArrow(_repeated_strings, _TOLD), allowMissingColumns=True)
    pieces = blocks.groupBy("_block").cogroup(told.groupBy("block")).applyInArrow(_send(sizes, 2 * count), "shard int, block int, keys binary, kinds binary, digests binary, twice binary, margins binary, text binary")
    starts = pieces.groupBy("shard").applyInArrow(_shard(sizes), _TOLD)
    added = widened(blocks, ["_row"], "n_bytes long, removed array<struct<start: long, end: long>>, kept binary, n_passage long")
    done = blocks.groupBy("_block").cogroup(told.unionByName(starts, allowMissingColumns=True).groupBy("block")).applyInArrow(_mark(sizes, characters), added)
    return done.select("_row.*", "n_bytes", "removed", "kept", "n_passage")
