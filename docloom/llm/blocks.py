"""Blocks of documents, and exchanges of packed hashes between blocks and buckets.

The substring operators look at each document several times, between rounds in which hashes
are counted over all documents. Documents are dealt once to blocks that fit a task; the rounds
of one query read that single exchange again. What a block sends to a hash bucket is one row of
packed, sorted, block-wise distinct hashes, so a passage that every document holds costs one
entry per block; what a bucket answers is one row per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U64, source_bytes, unpack_sorted

BLOCK_BYTES = 6 << 20  # of the source's files for each block


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of source files, and as many as the session's shuffles have partitions at least."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, min(1 << 22, math.ceil(source_bytes(docs) / block_bytes)))


def blocked(docs: DataFrame, count: int, columns: list[str]) -> DataFrame:
    """The columns as _row, doc_id as _id, the text's bytes as _text and a hash _hash of them, dealt to blocks _block."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    own = own.withColumn("_hash", F.xxhash64("_text"))
    # never null, so that no join adds a filter below the exchange, which would not be reused then
    return own.withColumn("_block", F.coalesce(F.pmod(F.xxhash64("_id", "_hash"), F.lit(count)).cast("int"), F.lit(0))).repartition(count, "_block")


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in the order that decides which copy is first: doc_id (null last), then the text's hash."""
    return table.sort_by([("_id", "ascending"), ("_hash", "ascending")])


def bucket_edges(sorted_values: np.ndarray, bits: int, bucket_bits: int) -> np.ndarray:
    """Where each of the 2**bucket_bits equal ranges of values of `bits` bits begins, and the end."""
    edges = np.arange(1, 1 << bucket_bits, dtype=U64) << U64(bits - bucket_bits)
    return np.concatenate(([0], np.searchsorted(sorted_values, edges), [len(sorted_values)]))


def answers(table: pa.Table, column: str = "blob") -> np.ndarray:
    """All values that the buckets have sent to one block, sorted."""
    parts = [unpack_sorted(b) for b in table[column].to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def pack_fixed(values: np.ndarray) -> bytes:
    """Unsigned values at the smallest common width, with their minimum apart."""
    if not len(values):
        return b""
    low = values.min()
    rest = values - low
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(low).to_bytes(8, "little") + rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_fixed(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width, low = blob[0], int.from_bytes(blob[1:9], "little")
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :width] = body
    return wide.reshape(-1).view("<u8").astype(U64) + U64(low)
