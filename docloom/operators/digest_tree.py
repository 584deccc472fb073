"""Stored trees of digests over paths, and a comparison of two collections that descends only where digests differ.

A file belongs to the leaf that the first hexadecimal digits of its path's digest name, so files are spread evenly
and adding one changes one leaf. A leaf's digest is that of its files' paths and content digests in order; a node's is that of its up
to sixteen children. Trees of one depth are compared from the root: the children of nodes that differ are looked at, and of the
leaves that differ their files. Each level, and the files by their first digit pairs, is a folder of its own, so what is equal is not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, shared_path

DEPTH = 3  # hexadecimal digits of a leaf: 4096 leaves
_FILES, _NODES = "node string, path string, digest string, part string", "node string, digest string, n long, level int"


@dataclass(frozen=True)
class Tree:
    spark: SparkSession
    path: str
    depth: int

    def nodes(self, level: int) -> DataFrame:
        """node, digest and n (files below) of a level; the root is level 0 and its name is empty."""
        return self.spark.read.schema(_NODES).parquet(f"{self.path}/nodes").where(F.col("level") == level).drop("level")

    def files(self, parts: list[str] | None = None) -> DataFrame:
        """node, path and digest of the files, of some parts only."""
        rows = self.spark.read.schema(_FILES).parquet(f"{self.path}/files")
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")

    def root(self) -> str | None:
        """The digest of the whole collection; null if it is empty."""
        row = self.nodes(0).first()
        return row and row.digest


def _joined(key: str, digest: str) -> Column:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(key, digest))), lambda x: F.concat(x[key], F.lit("\0"), x[digest]))
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def build(files: DataFrame, path: str | None = None, depth: int = DEPTH) -> Tree:
    """Writes the tree of files (path, content or digest), whose paths are distinct, below a folder. A null content is not an empty one.

    Depth grows with the collection: a leaf should have some hundred files at most. The trees that are compared must have one depth.
    """
    if not 1 <= depth <= 8:
        raise ValueError("depth must be from 1 to 8")
    spark = files.sparkSession
    path = path or shared_path(spark, "digest-tree")
    digest = F.col("digest") if "digest" in files.columns else F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("-"))
    name = F.sha2(F.col("path").cast("binary"), 256)
    rows = files.select(F.substring(name, 1, depth).alias("node"), "path", digest.alias("digest"), F.substring(name, 1, min(depth, 2)).alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(f"{path}/files")
    tree = Tree(spark, path, depth)
    level = tree.files().groupBy("node").agg(_joined("path", "digest").alias("digest"), F.count("*").alias("n"))
    for at in range(depth, -1, -1):
        level.write.parquet(f"{path}/nodes/level={at}")
        up = tree.nodes(at).withColumn("parent", F.expr("substring(node, 1, length(node) - 1)"))
        level = up.groupBy("parent").agg(_joined("node", "digest").alias("digest"), F.sum("n").alias("n")).withColumnRenamed("parent", "node")
    return tree


def differing_leaves(one: Tree, two: Tree) -> DataFrame:
    """node: the leaves that differ, or that one tree only has, found from the root down."""
    if one.depth != two.depth:
        raise ValueError("the trees have different depths")
    found = None
    for level in range(one.depth + 1):
        sides = [t.nodes(level).select("node", F.col("digest").alias(d)) for t, d in ((one, "d1"), (two, "d2"))]
        if found is not None:
            above = F.broadcast(found) if level <= 3 else found  # 16**2 rows at most above level 3
            sides = [s.withColumn("up", F.expr("substring(node, 1, length(node) - 1)")).join(above.select(F.col("node").alias("up")), "up", "left_semi").drop("up") for s in sides]
        found = cut(sides[0].join(sides[1], "node", "full").where(~F.col("d1").eqNullSafe(F.col("d2"))).select("node"))
        if found.isEmpty():
            break
    return found if level == one.depth else found.where("false")


def compare(stored: Tree, fresh: Tree) -> DataFrame:
    """path and problem: "missing" in the stored tree, "extra" there, or a "mismatch" of contents."""
    leaves = differing_leaves(stored, fresh)
    parts = [r.part for r in leaves.select(F.substring("node", 1, 2).alias("part")).distinct().collect()]  # 256 at most
    sides = [t.files(parts).join(leaves, "node", "left_semi").select("path", F.col("digest").alias(d)) for t, d in ((stored, "s"), (fresh, "f"))]
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("f").isNull(), "extra").when(F.col("s") != F.col("f"), "mismatch")
    return sides[0].join(sides[1], "path", "full").select("path", problem.alias("problem")).where("problem is not null")
