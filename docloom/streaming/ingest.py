"""Ingest by increments: a stream of files into a store of documents, references and chunks.

Each micro-batch is written to folders of its own, named by its id, and then committed by a marker. A batch that is run again
after a failure overwrites its own folders, so every batch counts exactly once; readers see committed batches only. A
document's rows of all tables are those of its latest version: a new one replaces its document, references and chunks, and
nothing of other documents is read or written. References are stored as their targets and resolved by readers, so
a link to a document that comes later is found then, as in a load of everything at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.markup import extract_links
from ..functions.text import is_external, path_candidates, resolve_href
from ..operators.chunking import chunk_flat
from ..sources import markdown

_DOCS = "path string, version long, deleted boolean, doc_type string, title string, description string, tags array<string>, status string, ts string, fm string, body string, batch long"
_REFS = "src string, href string, target string, version long, batch long"
_CHUNKS = "path string, policy string, ord int, text string, version long, batch long"


def file_stream(spark: SparkSession, directory: str, files_each: int = 1000) -> DataFrame:
    """A stream of files (path, content, version) from a folder's Parquet files, some of them a micro-batch."""
    return spark.readStream.schema("path string, content binary, version long").option("maxFilesPerTrigger", files_each).parquet(directory)


@dataclass(frozen=True)
class Store:
    """Documents, references and chunks below a folder that all executors share."""

    spark: SparkSession
    path: str
    size: int = 512  # words of a chunk
    overlap: int = 50

    def write(self, files: DataFrame, batch: int) -> None:
        """Writes and commits a batch of files (path, content, version). A null content removes a document. Of several rows of a path, that of the highest version counts, of equal versions that of the largest content."""
        last = files.groupBy("path").agg(F.max(F.struct("version", F.coalesce(F.col("content"), F.lit(b"")).alias("content"), F.col("content").isNull().alias("deleted"))).alias("x")).select("path", "x.*")
        docs = markdown.documents(last.select("path", "content")).join(last.select("path", "version", "deleted"), "path")
        names = [x.strip().split(" ")[0] for x in _DOCS.split(", ")][:-1]
        self._put("docs", docs.select(*names), batch)
        own = self.spark.read.schema(_DOCS).parquet(f"{self.path}/docs/batch={batch}").where("not deleted")
        each = own.select(F.col("path").alias("src"), "version", F.explode(extract_links("body")).alias("x")).select("src", F.col("x.href").alias("href"), "version")
        inside = each.where(~is_external(F.col("href"))).withColumn("target", resolve_href(F.col("href"), F.col("src"))).where("target is not null").distinct()
        parents = own.select(F.get_json_object("fm", "$.parent").alias("target"), "path", "version").where("target is not null")
        self._put("refs", inside.select("src", "href", "target", "version").unionByName(parents.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("href"), "target", "version")), batch)
        chunks = chunk_flat(own.select("path", "version", F.col("body").alias("text")), self.size, self.overlap)
        self._put("chunks", chunks.select("path", F.lit("flat").alias("policy"), "ord", "text", "version"), batch)
        self.spark.range(1).select(F.lit(batch).cast("long").alias("id")).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def _put(self, table: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def committed(self) -> DataFrame:
        return self.spark.read.schema("id long, batch long").parquet(f"{self.path}/commits").select("batch")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").join(self.committed(), "batch", "left_semi")

    def _latest(self) -> DataFrame:
        """path, version and batch of each document's latest version; of equal versions the later batch's."""
        rows = self._read("docs", _DOCS).select("path", "version", "deleted", "batch")
        return rows.groupBy("path").agg(F.max(F.struct("version", "batch", "deleted")).alias("x")).select("path", "x.*").where("not deleted")

    def documents(self) -> DataFrame:
        return self._read("docs", _DOCS).join(self._latest().select("path", "batch"), ["path", "batch"], "left_semi").drop("deleted", "batch")

    def chunks(self) -> DataFrame:
        return self._read("chunks", _CHUNKS).join(self._latest().select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")

    def edges(self) -> DataFrame:
        """src, dst and kind, as markdown.links finds them in all documents: references whose target is a document now."""
        latest = self._latest()
        known, now = latest.select("path"), latest.select(F.col("path").alias("src"), "batch")
        refs = self._read("refs", _REFS).join(now, ["src", "batch"], "left_semi")
        tried = refs.where("href is not null").select("src", "href", F.posexplode(path_candidates(F.col("target"))).alias("i", "path"))
        found = tried.join(known, "path").groupBy("src", "href").agg(F.min_by("path", "i").alias("dst"))
        prose = found.where("src <> dst").select("src", "dst", F.lit("prose").alias("kind")).distinct()
        child = refs.where("href is null").select(F.col("target").alias("src"), F.col("src").alias("dst"), F.lit("child").alias("kind"))
        return child.unionByName(prose)

    def changed(self, batch: int) -> DataFrame:
        """The chunks that a batch brought and that are still current: what an embedding job has to do after it."""
        return self._read("chunks", _CHUNKS).where(F.col("batch") == batch).join(self._latest().select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes what the stream has now into the store, batch by batch, and ends. Started again with the same checkpoint it goes on where it was."""
    return stream.writeStream.foreachBatch(store.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
