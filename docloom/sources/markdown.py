"""Markdown collections: reading files, front matter, documents and links; and JSON lines, Parquet exchange and bundles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions.markup import extract_links
from ..functions.text import is_external, path_candidates, resolve_href
from ..operators.lineage import kept, spread

#: Front-matter keys that have columns of their own (fixed values).
CORE_KEYS = ("type", "title", "description", "status", "timestamp")


def read_files(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """path (relative) and content of the files below a directory, from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(directory)
    root = directory.rstrip("/").split("://", 1)[-1]
    return files.select(F.substring_index(F.col("path"), root + "/", -1).alias("path"), "content")


def _front(text: str) -> str:
    """Front matter as JSON. The parser in C takes a tenth of the time; what it refuses is left to the one in Python."""
    import yaml

    try:
        told = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        told = yaml.safe_load(text)
    return json.dumps(told or {}, default=str)


@F.pandas_udf(K.StructType().add("front", "string").add("body", "string"))
def split_front_matter(texts: pd.Series) -> pd.DataFrame:
    """The front matter as JSON, and the body; a text without a fence is all body."""
    rows = []
    for text in texts:
        parts = (text or "").split("---\n", 2)
        if len(parts) == 3 and parts[0] == "":
            rows.append((_front(parts[1]), parts[2]))
        else:
            rows.append(("{}", text or ""))
    return pd.DataFrame(rows, columns=["front", "body"])


@F.pandas_udf(K.StringType())
def front_matter_page(front: pd.Series, body: pd.Series) -> pd.Series:
    """A page of front matter, given as a JSON object whose keys keep their order, and a body; null keys are left out."""
    import yaml

    def page(front: str | None, body: str | None) -> str:
        fields = {k: v for k, v in json.loads(front or "{}").items() if v is not None}
        return f"---\n{yaml.safe_dump(fields, sort_keys=False, allow_unicode=True)}---\n{body or ''}\n"

    return pd.Series([page(*row) for row in zip(front, body)])


def documents(files: DataFrame) -> DataFrame:
    """docs: path, doc_type, title, description, tags, status, ts, fm (a variant of the other keys), body, breadcrumb, depth, char_len."""
    parsed = files.select("path", split_front_matter(F.col("content").cast("string")).alias("x"))
    front, body = F.col("x.front"), F.col("x.body")
    one = lambda k: F.get_json_object(front, f"$.{k}")
    fields = F.from_json(front, "map<string, string>")
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*CORE_KEYS))
    crumbs = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return parsed.select(
        "path", one("type").alias("doc_type"), one("title").alias("title"), one("description").alias("description"), F.from_json(one("tags"), "array<string>").alias("tags"),
        one("status").alias("status"), one("timestamp").alias("ts"), F.to_json(rest).alias("fm"), body.alias("body"), crumbs.alias("breadcrumb"), F.size(crumbs).alias("depth"), F.length(body).alias("char_len"),
    )


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): child links from each document's parent, prose links to what its body names, once each; and the internal links that name nothing."""
    known = docs.select("path")
    each = docs.select(F.col("path").alias("src"), F.explode(extract_links("body")).alias("x")).select("src", F.col("x.href").alias("href"))
    inside = each.where(~is_external(F.col("href"))).withColumn("target", resolve_href(F.col("href"), F.col("src"))).where("target is not null")
    tried = inside.select("src", "href", F.posexplode(path_candidates(F.col("target"))).alias("i", "path"))
    found = tried.join(known, "path").groupBy("src", "href").agg(F.min_by("path", "i").alias("dst"))
    child = docs.select(F.get_json_object("fm", "$.parent").alias("src"), F.col("path").alias("dst"), F.lit("child").alias("kind")).where("src is not null")
    prose = found.where("src <> dst").select("src", "dst", F.lit("prose").alias("kind")).distinct()
    return child.unionByName(prose), inside.select("src", "href").distinct().join(found, ["src", "href"], "left_anti")


def ingest(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Documents and links of a directory; a link that names nothing is an error."""
    docs = kept(documents(spread(read_files(spark, directory), "path")), "docs")
    edges, unresolved = links(docs)
    lost = unresolved.limit(50).collect()  # for the message only
    if lost:
        raise ValueError("unresolved links: " + "; ".join(f"{r['src']} -> {r['href']}" for r in lost))
    return docs, edges


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    rows.select(*sorted(rows.columns)).write.json(path)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """chunk_id, doc_id and text for an embedding job, by document and place."""
    chunks.repartitionByRange("doc_id", "ord").sortWithinPartitions("doc_id", "ord").select("chunk_id", "doc_id", "text").write.parquet(path)


def embed(chunks: DataFrame, encode, column: str = "text") -> DataFrame:
    """chunk_id, doc_id and vector: encode maps a list of texts to vectors, a batch at a time."""

    def run(frames):
        for frame in frames:
            vectors = encode(frame[column].fillna("").tolist())
            yield frame[["chunk_id", "doc_id"]].assign(vector=[[float(x) for x in v] for v in vectors])

    kinds = chunks.select("chunk_id", "doc_id").schema
    return chunks.select("chunk_id", "doc_id", column).mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", vector array<float>")


def write_csv(rows: DataFrame, path: str, comment: str | None = None) -> None:
    """CSV with a header; with a comment, which is its first line, one file (a report)."""
    if comment is None:
        rows.write.option("header", True).csv(path)
        return
    header = rows.sparkSession.createDataFrame([(0, comment), (1, ",".join(rows.columns))], "n int, value string")
    lines = rows.select(F.lit(2).alias("n"), F.to_csv(F.struct(*rows.columns)).alias("value"))
    header.unionByName(lines).repartition(1).sortWithinPartitions("n", "value").select("value").write.text(path)


def fields(docs: DataFrame) -> DataFrame:
    """Field rows (path, doc_type, field, kind, vals, num) of documents' front matter, as operators/metadata.py takes them."""
    each = docs.select("path", "doc_type", F.explode(F.from_json("fm", "map<string, string>")).alias("field", "value")).where("value is not null")
    v = F.col("value")
    kind = F.when(v.isin("true", "false"), "bool").when(v.rlike(r"^-?\d+$"), "int").when(v.rlike(r"^\[.*\]$"), "list").when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").otherwise("str")
    vals = F.when(kind == "list", F.from_json(v, "array<string>")).otherwise(F.array(v))
    num = F.when(kind == "int", v.try_cast("double")).when(kind == "bool", (v == "true").cast("double"))
    return each.select("path", "doc_type", "field", kind.alias("kind"), vals.alias("vals"), num.alias("num"))
