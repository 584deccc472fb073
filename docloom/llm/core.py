"""Helpers shared by the corpus operators: Arrow text access, hashing, packed exchanges."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: Odd multipliers of the hashes below; any odd 64-bit numbers would do.
MUL_A, MUL_B, MUL_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BYTE_BASE = 0xD6E8FEB86659FD93
#: Text bytes that one numpy step takes at a time, which bounds a worker's memory.
STEP_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; on a single machine, as in tests, one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process
        jvm = spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{checkpoint_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written as a Parquet table to the shared folder and read back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_bytes(docs: DataFrame, text: str = "text") -> int:
    """About how many bytes of files docs comes from: the sizes of the tables it reads, without a job; where those are unknown, half of its text's bytes."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    if all(x.nodeName() in ("LogicalRelation", "LocalRelation") for x in found):
        return sum(int(str(x.stats().sizeInBytes())) for x in found)
    return (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2


def widened(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """The schema of df's columns, of any names, and of what the DDL adds."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(ddl).fields)


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and each whole row as one column _boxed, so that no other name can clash."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_boxed"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a binary column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def binary_rows(values: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A binary column of rows of the given lengths, which follow one another in values; null where told."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    valid = None if null is None else pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8).reshape(-1))])


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of about limit bytes each, a longer row alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * MUL_B
    x = x ^ (x >> U64(27))
    x = x * MUL_C
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U64)
    out[1:] = U64(base)
    return np.multiply.accumulate(out)


class PrefixHash:
    """Polynomial hashes modulo 2**64 of any spans of a sequence, from prefix sums (Rabin-Karp)."""

    def __init__(self, base: int = BYTE_BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words of more bytes are hashed by a digest.
LONG_WORD = 256
_KEPT = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, which are not empty: mixed after every eight bytes, so that no structure of the bytes carries over as in a polynomial; long spans by BLAKE2."""
    sizes = stops - starts
    out = mix((sizes.astype(U64) + MUL_C) * MUL_A)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero(sizes <= LONG_WORD)
    at, rest = starts[left], sizes[left]
    while len(left):
        part = eights[at] & _KEPT[np.minimum(rest, 8)]
        out[left] = mix((out[left] ^ mix(part * MUL_A)) + MUL_B)
        more = np.flatnonzero(rest > 8)
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : stops[i]], digest_size=8).digest(), "little")
    return out


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of many texts at once."""

    def __init__(self, lower: bool = False) -> None:
        self.lower = np.frombuffer(LOWER, np.uint8) if lower else None

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, end byte) of each word, and the n + 1 word offsets of the texts."""
        base = int(offsets[0])
        part = raw[base : int(offsets[-1])]
        if not len(part):
            zero = np.zeros(0, np.int64)
            return np.zeros(0, U64), zero, zero, np.zeros(len(offsets), np.int64)
        inside = ~_SPACE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1] - base
        cuts = cuts[cuts < len(part)]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        back = cuts[cuts > 0] - 1
        ends[back] = inside[back]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashes = span_hashes(part if self.lower is None else self.lower[part], starts, stops)
        return hashes, starts + base, stops + base, np.searchsorted(starts, offsets - base)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them."""
    by = np.argsort(values)
    ordered = values[by]
    new = np.ones(len(by), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(by), np.int64)
    at[by] = np.cumsum(new) - 1
    return ordered[new], at


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as their first value and fixed-width differences."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + body.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body) + 1, 8), np.uint8)
    wide[1:, :width] = body
    out = wide.reshape(-1).view("<u8").astype(U64)
    out[0] = first
    return np.cumsum(out, dtype=U64)


def give_back() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
