"""A persisted index of vectors: k-means cells, one folder each, and searches that read only the cells they probe.

Cells are fitted on a bounded sample; every vector is stored, in its nearest cell, with its distance to the centre (its
residual's length). A query probes the cells of the nearest centres. A cell's bound, the centre's inner product with the query plus
the query's length times the cell's largest residual, is the most that any vector of the cell reaches, so the exact
search probes on until no cell's bound reaches the k-th score: it equals a scan of all vectors. Large cells are stored
and searched in parts, so a vector that a third of all rows share is no single task's.

Tables below one folder: vectors (cell, part, unit_id, embedding) and cells (cell, centre, radius, n, parts, probes).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import ranking
from .lineage import cut, shared_path

SAMPLE = 16_384  # vectors that the cells are fitted on, those of the smallest hashes of their ids
MOST_CELLS = 1_024
ROUNDS = 12  # of k-means
PART = 50_000  # vectors of a cell's part
RECALL = 0.95  # within the sample, which the number of probes is fitted to


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def vectors(self, cells: list[int]) -> DataFrame:
        """The vectors of some cells: others' folders are not read."""
        return self.spark.read.parquet(f"{self.path}/vectors").where(F.col("cell").isin(cells))


def fit_cells(sample: np.ndarray, n_cells: int, seed: int = 7) -> np.ndarray:
    """Centres of at most n_cells cells of the sample's rows, by k-means; repeated rows are one choice of a first centre, and empty cells go."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:n_cells]]
    for _ in range(ROUNDS):
        nearest = _nearest(sample, centres)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equally near ones the first."""
    return np.argmax(rows @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def fit_probes(sample: np.ndarray, centres: np.ndarray, k: int = 10, recall: float = RECALL, asked: int = 256) -> int:
    """How many cells a query must probe so that it meets that share of its k best among the sample, for the first `asked` of its rows. Of all vectors the best are nearer than those of a sample, so they are met no less."""
    if not len(sample):
        return 1
    queries, cell = sample[:asked], _nearest(sample, centres)
    inner = queries @ centres.T - (centres**2).sum(axis=1) / 2
    place = np.argsort(np.argsort(-inner, axis=1), axis=1)  # of each cell in a query's order of probes
    best = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : min(k, len(sample))]
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).reshape(-1))
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def build(vectors: DataFrame, path: str | None = None, n_cells: int | None = None, seed: int = 7) -> Index:
    """Writes the index of vectors (unit_id, embedding), all of one length, below the path, by default a new one in the shared folder.

    Null vectors are refused. By default there are as many cells as the root of the number of vectors, MOST_CELLS at most.
    """
    spark = vectors.sparkSession
    path = path or shared_path(spark, "vector-index")
    told = vectors.agg(F.count("*").alias("n"), F.count("embedding").alias("whole"), F.coalesce(F.min(F.size("embedding")), F.lit(0)).alias("least"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("most")).first()
    if told.n != told.whole or told.least != told.most:
        raise ValueError("vectors must not be null and must be of one length")
    sampled = vectors.select("embedding").orderBy(F.xxhash64(F.col("unit_id").cast("string"))).limit(SAMPLE).toPandas()["embedding"]
    sample = np.array(sampled.tolist(), np.float64).reshape(len(sampled), told.most)
    centres = fit_cells(sample, n_cells or min(MOST_CELLS, max(1, math.isqrt(told.n))), seed) if told.n else np.zeros((0, told.most))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"), told.most)
            cell = _nearest(rows, centres) if len(rows) else np.zeros(0, np.int64)
            far = np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    own = vectors.select("unit_id", "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    assigned = own.mapInArrow(assign, f"{kinds}, cell int, far double")
    part = F.pmod(F.xxhash64(F.col("unit_id").cast("string"), F.col("far")), F.lit(1 << 20))
    # files of a cell by ranges of a hash, so that a large cell is written by several tasks
    assigned.withColumn("at", part).repartition("cell", F.pmod("at", F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")
    found = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")) if told.n else spark.createDataFrame([], "cell int, radius double, n long")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    found.join(F.broadcast(table), "cell").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("probes", F.lit(fit_probes(sample, centres))).write.parquet(f"{path}/cells")  # MOST_CELLS rows at most
    return Index(spark, path)


def _probe(queries: DataFrame, cells: list, probes: int | None) -> DataFrame:
    """query_id, embedding, cell, parts and bound: for each query its nearest cells, all of them if probes is None."""
    centres = np.array([c.centre for c in cells], np.float64)
    radius, parts = np.array([c.radius for c in cells]), np.array([c.parts for c in cells], np.int32)
    number, half = np.array([c.cell for c in cells], np.int32), (centres**2).sum(axis=1) / 2
    n = min(probes or len(cells), len(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("embedding"), centres.shape[1])
            inner = rows @ centres.T
            chosen = np.argpartition(half - inner, n - 1, axis=1)[:, :n] if n < len(cells) else np.tile(np.arange(len(cells)), (len(rows), 1))
            q, c = np.repeat(np.arange(len(rows)), n), chosen.reshape(-1)
            bound = inner[q, c] + np.sqrt((rows**2).sum(axis=1))[q] * radius[c]
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), pa.array(number[c]), pa.array(parts[c]), pa.array(bound)], ["query_id", "cell", "parts", "bound"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, cell int, parts int, bound double")


def _in_cells(index: Index, queries: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """query_id, unit_id and score of what may be among the first k of each query's probed cells (query_id, cell, parts)."""
    cells = sorted(r.cell for r in probed.select("cell").distinct().collect())  # MOST_CELLS at most
    asked = probed.join(queries.select("query_id", "embedding"), "query_id")
    asked = asked.select("query_id", F.col("embedding").alias("asked"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = index.vectors(cells).join(F.broadcast(index.cells().select("cell", "parts")), "cell")
    held = held.select("unit_id", "embedding", "cell", F.pmod("at", F.col("parts")).cast("int").alias("part"))
    unit, query = held.schema["unit_id"].dataType, queries.schema["query_id"].dataType
    names, kinds = ["query_id", "unit_id", "score"], [to_arrow_type(query), to_arrow_type(unit), pa.float64()]

    def run(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        out = [pa.schema(list(zip(names, kinds))).empty_table()]
        if vectors.num_rows and asking.num_rows:
            rows = np.asarray(vectors["embedding"].combine_chunks().flatten(), np.float64).reshape(vectors.num_rows, -1)
            for at in range(0, asking.num_rows, 1024):
                some = asking.slice(at, 1024)
                wanted = np.asarray(some["asked"].combine_chunks().flatten(), np.float64).reshape(some.num_rows, -1)
                scores = np.round(wanted @ rows.T, 6) + 0.0
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if k < scores.shape[1] else np.full((len(scores), 1), -np.inf)
                q, r = np.nonzero(scores >= least)  # ties at the edge stay for the global order
                out.append(pa.Table.from_arrays([some["query_id"].take(pa.array(q)), vectors["unit_id"].take(pa.array(r)), pa.array(scores[q, r])], names))
        return pa.concat_tables(out)

    return held.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(run, f"query_id {query.simpleString()}, unit_id {unit.simpleString()}, score double")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, unit_id, score (inner product, 6 decimals) and rank; ties go to the smaller unit.

    Probes the `probes` nearest cells of each query (query_id, embedding), by default as many as were fitted when the index was built. Queries whose cells hold fewer than k vectors
    probe all cells. With exact, each query then probes every cell whose bound reaches its k-th score, so the result is that of
    all vectors.
    """
    cells = index.cells().orderBy("cell").collect()  # MOST_CELLS rows at most
    if not cells:
        empty = queries.where("false")
        return empty.select("query_id", F.lit(None).cast("long").alias("unit_id"), F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank"))
    asked, probes = cut(queries.select("query_id", "embedding")), probes or cells[0].probes
    first = cut(_probe(asked, cells, probes))
    found = cut(_in_cells(index, asked, first, k))
    reached = ranking.top(found, k, F.col("score").desc(), F.col("unit_id"))
    least = reached.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    every = _probe(asked, cells, None).join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(least, "query_id", "left")
    # one unit of the sixth decimal for the rounding of scores
    more = cut(every.where(F.col("least").isNull() | (F.lit(exact) & (F.col("bound") + 1e-6 >= F.col("least")))).select("query_id", "cell", "parts"))
    if not more.isEmpty():
        found = found.unionByName(_in_cells(index, asked, more, k))
    return ranking.top(found, k, F.col("score").desc(), F.col("unit_id"))
