"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

Tokens of both sides are read by a transducer. Its state is the dangling suffix: which side leads, and its bytes
that the other side has not reached. The side that lags reads its next token; where nothing dangles a group closes.
Transitions are memoised by residual and next token, so a step is a dictionary look-up. Every token of a group's
one side is linked with each of the other's.

Documents are encoded once. Each task packs the id pairs of some documents to a block and sends the block's distinct
pairs with their document counts once; counts are summed over rows (pair, count); each block then asks hash buckets of
pairs for the counts of its own. The space of pairs is 32 bits wide, so a bucket is bounded by the
vocabularies, and what asks a bucket is split by groups of blocks.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .blocks import pack_fixed, unpack_fixed
from .core import U64, buffers, give_back, pack_sorted, saved, steps, unpack_sorted, widened

#: The byte-level tokenizer's split into words, as its vocabulary file's kind defines it.
WORD_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

STEP = 1 << 20  # text bytes that are encoded at a time
WIDE = 256  # links of a group over which it is linked by its distinct ids
MIX = 0x9E3779B1  # odd: spreads pairs evenly over buckets, and can be undone
UNMIX = pow(MIX, -1, 1 << 32)
ASK_GROUP = 4096  # blocks that ask a bucket in one task


@dataclass(frozen=True)
class Tokenizers:
    """Files of a byte-level BPE vocabulary (side A) and of a sentencepiece model (side B); read on the driver."""

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"
    block_pairs: int = 1_000_000  # distinct pairs of documents that make a block
    memo: int = 4_000_000  # transitions that a task remembers before it begins anew

    def load(self) -> tuple[bytes, bytes]:
        return Path(self.byte_level).read_bytes(), Path(self.pieces).read_bytes()


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SideA:
    """Byte-level BPE without special tokens: ids and the bytes of each id."""

    def __init__(self, file: bytes) -> None:
        import tiktoken

        self.file, self.slow = file, None
        model, to_byte = json.loads(file)["model"], byte_characters()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in to_byte for c in token) and not token.startswith("<|")}
        merged = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        order = [model["vocab"][a + b] for a, b in merged]
        if order != sorted(order):
            raise ValueError("the merges of the byte-level vocabulary are not in the order of its ids")
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.fast = tiktoken.Encoding("side-a", pat_str=WORD_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        found = []
        for text in texts:
            try:
                found.append(self.fast.encode_ordinary(text))
            except BaseException as error:  # its regular expressions give up on very long runs of white space, by a panic
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                found.append(self._exact(text))
        return found

    def _exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_buffer(self.file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class SideB:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, file: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Transducer:
    """Reads the tokens of both sides and tells where both end. State 0 has no dangling suffix; there side A reads next."""

    def __init__(self, a: list[bytes], b: list[bytes], memo: int) -> None:
        self.tokens, self.memo = (a, b), memo
        self._begin()

    def _begin(self) -> None:
        self.numbers, self.states, self.turn, self.next, self.size = {(0, b""): 0}, [(0, b"")], [0], [{}], 0

    def _step(self, state: int, token: int) -> int:
        """The state after a transition that is not known yet."""
        leads, dangling = self.states[state]
        reads = self.turn[state]
        new = self.tokens[reads][token]
        if dangling.startswith(new):
            leads, rest = leads, dangling[len(new) :]
        elif new.startswith(dangling):
            leads, rest = reads, new[len(dangling) :]
        else:
            raise ValueError("the tokens of the two sides spell different bytes")
        key = (leads, rest) if rest else (0, b"")
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.turn.append(1 - leads)
            self.next.append({})
        self.next[state][token] = found
        self.size += 1
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """Of each group, how many tokens of a, and of b, end at its end; a and b spell the same bytes."""
        if self.size > self.memo:
            self._begin()
        step, turn, state, i, j = self.next, self.turn, 0, 0, 0
        ends_a, ends_b = [], []
        for _ in range(len(a) + len(b)):
            if turn[state]:
                token = b[j]
                j += 1
            else:
                token = a[i]
                i += 1
            to = step[state].get(token)
            state = self._step(state, token) if to is None else to
            if not state:
                ends_a.append(i)
                ends_b.append(j)
        return ends_a, ends_b


def _spelled(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids' strings one after another, and their n + 1 offsets."""
    taken = table.take(pa.array(ids, pa.int64()))
    return buffers(taken)


class Aligner:
    """Texts to groups, links and their digests."""

    def __init__(self, files: tuple[bytes, bytes], memo: int) -> None:
        self.a, self.b = SideA(files[0]), SideB(files[1])
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("pairs of ids of these vocabularies do not fit 32 bits")
        self.transducer = Transducer(self.a.bytes, self.b.bytes, memo)
        self.table_a, self.table_b = pa.array(self.a.bytes, pa.binary()), pa.array(self.b.bytes, pa.binary())
        written = [f"{i}{end}".encode() for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]
        self.written = pa.array(written, pa.binary())

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides; none for texts that are null or empty, or that either side spells otherwise."""
        at = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in at]
        out_a, out_b = [[]] * len(texts), [[]] * len(texts)
        ids_a, ids_b = self.a(spaced), self.b([texts[i] for i in at])
        for i, text, a, b in zip(at, spaced, ids_a, ids_b):
            want = text.encode()
            if self._spell(self.table_a, a) == want and self._spell(self.table_b, b) == want:
                out_a[i], out_b[i] = a, b
        return out_a, out_b

    @staticmethod
    def _spell(table: pa.Array, ids: list[int]) -> bytes:
        raw, offsets = _spelled(table, np.array(ids, np.int64))
        return raw[offsets[0] : offsets[-1]].tobytes()

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, mixed pairs, times) of each text; pairs are sorted and distinct."""
        found = []
        for a, b in zip(*self.encode(texts)):
            if not a:
                found.append((0, 0, 0, 0, "", np.zeros(0, U64), np.zeros(0, U64)))
                continue
            ends = [np.array(e, np.int64) for e in self.transducer.groups(a, b)]
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            pairs, times = self._links(a, b, *ends)
            found.append((len(a), len(b), len(ends[0]), int(times.sum()), self._digest(a, b, *ends), pairs, times))
        return found

    def _digest(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        n, sizes_a, sizes_b = len(ends_a), np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = 1
        last_b[ends_b - 1] = 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(ends_b - sizes_b, sizes_a)] = a + last_a * self.n_a
        order[np.arange(len(b)) + np.repeat(ends_a, sizes_b)] = 2 * self.n_a + b + last_b * self.n_b
        raw, offsets = _spelled(self.written, order)
        return hashlib.sha256(raw[offsets[0] : offsets[-1] - 1].tobytes()).hexdigest() if n else ""

    def _links(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        starts_a, starts_b, each = ends_a - sizes_a, ends_b - sizes_b, sizes_a * sizes_b
        narrow = np.flatnonzero(each <= WIDE)
        group = np.repeat(narrow, each[narrow])
        within = np.arange(len(group)) - np.repeat(np.cumsum(each[narrow]) - each[narrow], each[narrow])
        codes = [a[starts_a[group] + within // sizes_b[group]] * self.n_b + b[starts_b[group] + within % sizes_b[group]]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(each > WIDE).tolist():
            own_a, times_a = np.unique(a[starts_a[g] : ends_a[g]], return_counts=True)
            own_b, times_b = np.unique(b[starts_b[g] : ends_b[g]], return_counts=True)
            codes.append((own_a[:, None] * self.n_b + own_b).reshape(-1))
            times.append(np.outer(times_a, times_b).reshape(-1))
        mixed = (np.concatenate(codes).astype(U64) * U64(MIX)) & U64(0xFFFFFFFF)
        if len(codes) == 1:
            pairs, counts = np.unique(mixed, return_counts=True)
            return pairs, counts.astype(U64)
        return _summed(mixed, np.concatenate(times).astype(U64))


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the sum of the weights of each."""
    by = np.argsort(values, kind="stable")
    values = values[by]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(weights[by], first) if len(first) else weights[:0]


@lru_cache(maxsize=1)
def _aligner(files: tuple[bytes, bytes], memo: int) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    return Aligner(files, memo)


def _decoded(raw: bytes | None) -> str | None:
    """A text; null where its bytes are not UTF-8, which no tokens spell."""
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


_LONGS = ("n_a", "n_b", "n_groups", "n_links")


def _encode_part(files: tuple[bytes, bytes], tokenizers: Tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, block, held, seen = _aligner(files, tokenizers.memo), TaskContext.get().partitionId() << 32, [], 0

        def whole(kind: pa.DataType) -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            empty = [pa.nulls(1, kind), *[pa.nulls(1, pa.int64()) for _ in _LONGS], pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2]
            return _batch([pa.array([block], pa.int64()), *empty, pa.array([pack_sorted(pairs)], pa.binary()), pa.array([pack_fixed(docs.astype(U64))], pa.binary())])

        kind = None
        for batch in batches:
            kind, texts = batch.column("_row").type, batch.column("_text")
            _, offsets = buffers(texts)
            for i, j in steps(offsets, STEP):
                rows = align([_decoded(t) for t in texts.slice(i, j - i).to_pylist()])
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                blobs = [pa.array([f(r[k]) for r in rows], pa.binary()) for k, f in ((5, pack_sorted), (6, pack_fixed))]
                yield _batch([pa.array([block] * len(rows), pa.int64()), batch.column("_row").slice(i, j - i), *numbers, pa.array([r[4] for r in rows], pa.string()), *blobs, *[pa.nulls(len(rows), pa.binary())] * 2])
                held += [r[5] for r in rows]
                seen += sum(len(r[5]) for r in rows)
                if seen >= tokenizers.block_pairs:
                    yield whole(kind)
                    block, held, seen = block + 1, [], 0
        if held:
            yield whole(kind)
        give_back()

    return run


_NAMES = ["block", "_row", *_LONGS, "groups_sha256", "pairs", "times", "asked", "docs"]


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _counted(n_b: int):
    """Rows (a, pair, n): in how many documents of a task's blocks a pair stands."""

    def told(pairs: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = _summed(np.concatenate(pairs), np.concatenate(docs))
        first = ((values * U64(UNMIX)) & U64(0xFFFFFFFF)) // U64(n_b)
        return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["a", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, held = [], [], 0
        for batch in batches:
            for asked, own in zip(batch.column("asked").to_pylist(), batch.column("docs").to_pylist()):
                pairs.append(unpack_sorted(asked))
                docs.append(unpack_fixed(own))
                held += len(pairs[-1])
                if held >= 4_000_000:
                    yield told(pairs, docs)
                    pairs, docs, held = [], [], 0
        if held:
            yield told(pairs, docs)
        give_back()

    return run


def _questions(bits: int):
    """Each block's pairs, a row for each bucket that has some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, part, asked in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("asked").to_pylist()):
                pairs = unpack_sorted(asked)
                edges = np.searchsorted(pairs, np.arange((1 << bits) + 1, dtype=U64) << U64(32 - bits))
                rows += [(b, part, block, pack_sorted(pairs[lo:hi])) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if lo < hi]
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "part", "block", "asked"), r)) for r in rows], schema=pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("asked", pa.binary())]))

    return run


_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary())])


def _answer(questions: pa.Table, known: pa.Table) -> pa.Table:
    """The counts of the pairs that blocks ask a bucket for, doubled, plus one where it is the highest of the pair's A id."""
    if not questions.num_rows:
        return _REPLY.empty_table()
    pairs = known["pair"].to_numpy().astype(U64)
    by = np.argsort(pairs)
    pairs, said = pairs[by], (known["n"].to_numpy().astype(U64) * U64(2) + known["best"].to_numpy().astype(U64))[by]
    replies = [pack_fixed(said[np.searchsorted(pairs, unpack_sorted(asked))]) for asked in questions["asked"].to_pylist()]
    return pa.Table.from_arrays([questions["block"], questions["bucket"], pa.array(replies, pa.binary())], schema=_REPLY)


def _finish(kept: list[str]):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        is_doc = np.array([p is not None for p in rows["pairs"].to_pylist()], bool)
        docs = rows.filter(pa.array(is_doc))
        asked = unpack_sorted(rows.filter(pa.array(~is_doc))["asked"][0].as_py())
        ordered = replies.sort_by("bucket")
        said = np.concatenate([np.zeros(0, U64), *[unpack_fixed(r) for r in ordered["reply"].to_pylist()]])
        best, total = [], []
        for pairs, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist()):
            own, n = said[np.searchsorted(asked, unpack_sorted(pairs))], unpack_fixed(times)
            best.append(int((n * (own & U64(1))).sum()))
            total.append(int((n * (own >> U64(1))).sum()))
        row = docs["_row"].combine_chunks()
        columns = [row.field(i) if not row.null_count else pa.compute.struct_field(row, i) for i in range(len(kept))]
        return pa.Table.from_arrays([*columns, *[docs[c] for c in _LONGS], pa.array(best, pa.int64()), pa.array(total, pa.int64()), docs["groups_sha256"]], names=[*kept, *_LONGS, "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, *keep: str, tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """The kept columns of every row with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Side A encodes a space and the text, side B the text, both without special tokens. Texts that are null, empty or
    not UTF-8, and those of which either side spells other bytes (as texts with U+2581), have no tokens: zeros and an empty
    digest. A pair's count is the number of rows that hold it linked, repeated rows each; n_best has the links whose
    count is the highest of their A id, ties included.
    """
    files = tokenizers.load()
    side = SideB(files[1])
    n_b = len(side.bytes)
    kept = list(keep)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("text").cast("binary").alias("_text"))
    ddl = ", ".join(f"{c} long" for c in _LONGS) + ", groups_sha256 string, pairs binary, times binary, asked binary, docs binary"
    schema = StructType([*StructType.fromDDL("block long"), StructField("_row", own.schema["_row"].dataType), *StructType.fromDDL(ddl)])
    rows = saved(own.mapInArrow(_encode_part(files, tokenizers), schema), "aligned")
    blocks = rows.where(F.col("asked").isNotNull())
    n_blocks = blocks.count()
    bits = min(12, max(3, math.ceil(math.log2(2 * n_blocks + 1))))
    parts = math.ceil(n_blocks / ASK_GROUP) or 1

    counts = blocks.select("asked", "docs").mapInArrow(_counted(n_b), "a int, pair long, n long").groupBy("a", "pair").agg(F.sum("n").alias("n"))
    counts = saved(counts, "pair-counts")
    # at most one row for each id of side A
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    known = counts.join(F.broadcast(highest), "a").select(F.shiftright("pair", 32 - bits).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    questions = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "asked").mapInArrow(_questions(bits), "bucket int, part int, block long, asked binary")
    replies = questions.groupBy("bucket", "part").cogroup(known.groupBy("bucket", "part")).applyInArrow(_answer, "block long, bucket int, reply binary")
    out = widened(docs, kept, ", ".join(f"{c} long" for c in (*_LONGS, "n_best", "count_sum")) + ", groups_sha256 string")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_finish(kept), out)
