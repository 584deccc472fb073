"""WARC archives: writing pages as records, and reading records back by boundary-chain verification.

Reading. Spark's text source splits an archive at the magic line, so each task gets the pieces
between magics of one byte range; every magic is a candidate record. A task reads the
candidates' headers, computes their successor offsets (header + Content-Length + 4) and emits,
for each, the offset at which its chain leaves the range, and its place in the forest of chains.
Pointer jumping over these exits, from each file's start, finds the one candidate by which the
true chain enters each range; candidates on the path from it are records, all others are magic
inside payloads and are dropped. No task needs a whole file, and only Spark opens files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import saved, shared_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # fixed, so that writing twice gives the same bytes


@dataclass(frozen=True)
class Archive:
    min_revisit_bytes: int = 1000  # smaller payloads are always stored whole
    records_per_file: int = 100_000
    broadcast_rows: int = 100_000  # groups of equal payloads up to which their table is broadcast


def _header(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line ends and controls in a value are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\\r", "%0D"), "\\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def plan(pages: DataFrame, rule: Archive = Archive()) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, bytes, type and the page a revisit refers to.

    Of records with equal payloads of min_revisit_bytes or more, those with the largest page_id
    are responses (more than one only if rows repeat it, or if all are null) and the others
    revisit it. A null html is empty; a null url has no target line.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("_payload"))
    rows = rows.withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_sha": F.sha2(F.col("_payload").cast("binary"), 256)})
    groups = rows.where(F.col("_bytes") >= rule.min_revisit_bytes).groupBy("_sha").agg(F.max("page_id").alias("_main"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = saved(groups, "warc-groups")
    if groups.count() <= rule.broadcast_rows:  # else both sides are shuffled, and a hot payload's rows are split by the adaptive join
        groups = F.broadcast(groups)
    rows = rows.join(groups, "_sha", "left")
    revisit = F.col("_main").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_main")))
    return rows.select("page_id", "url", "_payload", "_bytes", F.sha1(F.col("_payload").cast("binary")).alias("_digest"), F.coalesce(revisit, F.lit(False)).alias("_revisit"), "_main")


def write(pages: DataFrame, path: str, rule: Archive = Archive()) -> None:
    """One record per row of pages, as uncompressed WARC files under path."""
    rows = plan(pages, rule)
    body = F.when(F.col("_revisit"), "").otherwise(F.col("_payload"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _header("WARC-Payload-Length", F.col("_bytes").cast("string")),
        _header("WARC-Refers-To", F.when(F.col("_revisit"), F.concat(F.lit("<urn:page:"), F.col("_main").cast("string"), F.lit(">")))),
        _header("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", rule.records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, with the file and the start of the byte range they were read from, in order within a range."""
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


_FIELDS = ["warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-payload-length", "warc-refers-to"]
_RANGE_SCHEMA = "file string, block long, at long, next long, exit long, low long, high long, total long, body long, length long, sha1 string, " + ", ".join(f"`{f}` string" for f in _FIELDS)


def _parse(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(body start, content length, fields) of what follows a magic, if it is a record's header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    return end + 4, int(length), fields


def _range_rows(file: str, block: int, pieces: list[tuple[int, bytes]], total: int, whole_first: bool) -> list[tuple]:
    """A row for each candidate of one byte range. Offsets are from where the range's own pieces begin.

    The piece before a file's first magic is no candidate. low and high number the chains' forest:
    a candidate is on the chain from e if low <= e.low < high.
    """
    start = {at: i for i, (at, _) in enumerate(pieces)}
    parsed = [None if whole_first and i == 0 else _parse(p) for i, (_, p) in enumerate(pieces)]
    n = len(pieces)
    step = np.full(n + 2, n, np.int64)  # n: leaves the range; n + 1: no record
    step[n + 1] = n + 1
    leaves = np.full(n + 2, -1, np.int64)
    for i, found in enumerate(parsed):
        if found is None:
            step[i] = n + 1
            continue
        after = pieces[i][0] + found[0] + found[1] + len(END)  # where the next magic must begin
        if after < total - len(MAGIC):  # the last piece is followed by the next range's first magic
            # a magic begins len(MAGIC) before its piece
            step[i] = start.get(after + len(MAGIC), n + 1)
        else:
            leaves[i] = after
    # pointer jumping within the range: each candidate's last record before it leaves
    jump = np.where(step == n, np.arange(n + 2), step)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    # numbers of the forest whose parents are successors: children follow their parent
    children: dict[int, list[int]] = {}
    for i in range(n):
        if step[i] <= n:
            children.setdefault(int(step[i]) if step[i] < n else -1 - i, []).append(i)
    low, high, clock = {}, {}, 0
    for root in sorted(k for k in children if k < 0):
        stack = [(children[root][0], False)]
        while stack:
            i, closed = stack.pop()
            if closed:
                high[i] = clock
                continue
            low[i] = clock
            clock += 1
            stack.append((i, True))
            stack += [(c, False) for c in children.get(i, ())]
    rows = []
    for i in range(n):
        if i not in low or jump[i] > n or leaves[jump[i]] < 0:
            continue
        at, (body, length, fields) = pieces[i][0], parsed[i]
        content, j = pieces[i][1][body : body + length], i
        while len(content) < length and j + 1 < n:  # a magic inside the payload cut it
            j += 1
            content += (MAGIC + pieces[j][1])[: length - len(content)]
        sha1 = hashlib.sha1(content).hexdigest() if len(content) == length else None
        after = int(leaves[i]) if step[i] == n else pieces[int(step[i])][0] - len(MAGIC)
        rows.append((file, block, at - len(MAGIC), after, int(leaves[jump[i]]), low[i], high[i], total, at + body, length, sha1, *(fields.get(f) for f in _FIELDS)))
    return rows


def _ranges_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64()] + [pa.int64()] * 8 + [pa.string()] * (1 + len(_FIELDS))
    names = [x.split()[0].strip("`") for x in _RANGE_SCHEMA.split(", ")]

    def made(key, pieces, total):
        rows = _range_rows(*key, pieces, total, key[1] == 0)
        if not rows:  # the range still counts for the offsets of those after it
            rows = [(*key, None, None, None, None, None, total, None, None, None, *[None] * len(_FIELDS))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    key, pieces, at = None, [], 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (file, block) != key:
                if key is not None:
                    yield made(key, pieces, at)
                key, pieces, at = (file, block), [], 0
            value = value.as_py() or b""
            pieces.append((at, value))
            at += len(value) + len(MAGIC)
    if key is not None:
        yield made(key, pieces, at)


def _cut_payloads(spark: SparkSession, path: str, cut: DataFrame, bases: DataFrame) -> DataFrame:
    """SHA-1 of the payloads that reach into a later byte range: only their own bytes are read again and shuffled."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (file, block) != key:
                    key, at = (file, block), 0
                value = value.as_py() or b""
                rows.append((file, block, at, value + MAGIC))
                at += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "block", "at", "value"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        start, stop = table["start"][0].as_py(), table["stop"][0].as_py()
        content = b"".join(table["value"].to_pylist())
        skip = start - table["at"][0].as_py()
        return pa.table({"file": table["file"][:1], "start": table["start"][:1], "whole": [hashlib.sha1(content[skip : skip + stop - start]).hexdigest()]})

    pieces = _pieces(spark, path).mapInArrow(numbered, "file string, block long, at long, value binary").join(bases, ["file", "block"])
    pieces = pieces.select("file", (F.col("at") + F.col("base")).alias("at"), "value")
    wanted = cut.select(F.col("file").alias("_file"), "start", "stop")
    parts = pieces.join(wanted, (F.col("file") == F.col("_file")) & (F.col("at") < F.col("stop")) & (F.col("at") + F.octet_length("value") > F.col("start")))
    return parts.drop("_file").groupBy("file", "start").applyInArrow(joined, "file string, start long, whole string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The verified records under path: file, offset, the header fields, length and the content's SHA-1."""
    found = saved(_pieces(spark, path).mapInArrow(_ranges_part, _RANGE_SCHEMA), "warc-ranges")
    totals = found.select("file", "block", "total").distinct()
    # byte ranges of one file, at its size over the split size of them
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), "total")
    nodes = found.where("at is not null").drop("total").join(bases, ["file", "block"])
    nodes = saved(nodes.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "exit", "body")}), "warc-nodes")
    jumps = nodes.select("file", F.col("at").alias("src"), F.col("exit").alias("dst"))
    reached = nodes.groupBy("file").agg(F.lit(0).cast("long").alias("at"))
    known = reached.count()
    while True:  # doubles the ranges walked with each round
        step = reached.join(jumps, (reached["file"] == jumps["file"]) & (reached["at"] == jumps["src"])).select(reached["file"], F.col("dst").alias("at"))
        reached = saved(reached.union(step).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            break
        known = now
        on = jumps.select(F.col("file").alias("file2"), F.col("src").alias("src2"), F.col("dst").alias("dst2"))
        jumps = saved(jumps.join(on, (F.col("file") == F.col("file2")) & (F.col("dst") == F.col("src2")), "left").select("file", "src", F.coalesce("dst2", "dst").alias("dst")), "warc-jumps")
    entries = reached.join(nodes.select("file", "at", "block", F.col("low").alias("entry")), ["file", "at"]).select("file", "block", "entry")
    records = nodes.join(entries, ["file", "block"]).where("low <= entry and entry < high").drop("entry", "low", "high", "exit", "base", "block")
    cut = records.where("sha1 is null").select("file", F.col("body").alias("start"), (F.col("body") + F.col("length")).alias("stop"))
    if not cut.isEmpty():
        whole = _cut_payloads(spark, path, cut, bases.select("file", "block", "base"))
        records = records.join(whole.withColumnRenamed("start", "body"), ["file", "body"], "left").withColumn("sha1", F.coalesce("sha1", "whole")).drop("whole")
    return records


def round_trip(pages: DataFrame, rule: Archive = Archive()) -> DataFrame:
    """Writes pages to the shared folder, reads the archives back, and returns a row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A response's bytes and digest
    are those of the payload as read; a revisit's are those its header names.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, rule)
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.regexp_extract(F.col(f"`{c}`"), "^<urn:page:(.*)>$", 1).cast(kind)
    response = F.col("`warc-type`") == "response"
    return read(spark, path).select(
        number("warc-record-id").alias("page_id"),
        F.when(response, F.col("length")).otherwise(F.col("`warc-payload-length`").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("sha1")).otherwise(F.substring("`warc-payload-digest`", 6, 40)).alias("payload_digest"),
        F.col("`warc-type`").alias("record_type"),
        number("warc-refers-to").alias("refers_to"),
    )
