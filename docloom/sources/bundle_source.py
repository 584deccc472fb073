"""Bundles as a data source: spark.read.format("bundle"), planned by ranges of files and pruned by filters on any text column.

A bundle is a folder of Parquet tables: docs, chunks, edges, and for each policy vectors_<policy>. In the pilot layout the
chunks carry their vectors themselves. Options: path; part (docs, chunks, edges or vectors); layout (v4, the
default, or pilot); policy, for vectors; range_bytes, for the size of a task's range. Filters on path, type and other text
columns are pushed: row groups whose least and greatest values rule them out are never opened, and what is read is filtered
before it reaches Spark. A vector that is null, and vectors of unlike lengths, end the read with an error: such
bundles must be embedded again. Paths are opened with Arrow's file systems, in tasks too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

_SCHEMAS = {
    "docs": "path string, doc_type string, title string, description string, tags array<string>, status string, fm string, body string",
    "chunks": "chunk_id string, path string, policy string, ord int, text string",
    "edges": "src string, dst string, kind string, provenance string",
    "vectors": "chunk_id string, path string, vector array<float>",
    "pilot chunks": "chunk_id string, path string, policy string, ord int, text string, vector array<float>",
}
ROWS_EACH = 20_000  # of a row group that is written


def _opened(path: str):
    """Arrow's file system for a path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    file: str
    groups: list[int]


def may_hold(test: Filter, least: str, greatest: str) -> bool:
    """Whether a value from least to greatest may pass the test."""
    if isinstance(test, EqualTo):
        return least <= test.value <= greatest
    if isinstance(test, In):
        return any(least <= v <= greatest for v in test.value)
    if isinstance(test, StringStartsWith):
        n = len(test.value)
        return least[:n] <= test.value <= greatest[:n]
    if isinstance(test, GreaterThan):
        return greatest > test.value
    if isinstance(test, GreaterThanOrEqual):
        return greatest >= test.value
    if isinstance(test, LessThan):
        return least < test.value
    if isinstance(test, LessThanOrEqual):
        return least <= test.value
    return True


def _expression(test: Filter) -> pc.Expression:
    field = pc.field(*test.attribute)
    if isinstance(test, IsNotNull):
        return field.is_valid()
    if isinstance(test, In):
        return field.isin(list(test.value))
    if isinstance(test, StringStartsWith):
        return pc.starts_with(field, test.value)
    return {EqualTo: field.__eq__, GreaterThan: field.__gt__, GreaterThanOrEqual: field.__ge__, LessThan: field.__lt__, LessThanOrEqual: field.__le__}[type(test)](test.value)


class BundleReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, range_bytes: int) -> None:
        self.folder, self.schema, self.range_bytes, self.tests = folder, schema, range_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        texts = {f.name for f in self.schema if isinstance(f.dataType, StringType)}
        known = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for test in filters:
            column = getattr(test, "attribute", ())  # a negation has none
            on_text = len(column) == 1 and column[0] in texts
            if on_text and (isinstance(test, IsNotNull) or isinstance(test, In) and all(isinstance(v, str) for v in test.value) or isinstance(test, known) and isinstance(test.value, str)):
                self.tests.append(test)
            else:
                yield test

    def _kept(self, group, places: dict[str, int]) -> bool:
        for test in self.tests:
            at = places.get(test.attribute[0])
            found = None if at is None else group.column(at).statistics
            if found is not None and found.has_min_max and not may_hold(test, found.min, found.max):
                return False
        return True

    def partitions(self) -> list[Range]:
        """Ranges of row groups, of about range_bytes of data; only the files' footers are read."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, folder = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        ranges = []
        for name in sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet")):
            meta, groups, size = pq.read_metadata(name, filesystem=system), [], 0
            places = {meta.schema.column(j).path: j for j in range(meta.num_columns)}
            for i in range(meta.num_row_groups):
                group = meta.row_group(i)
                if self._kept(group, places):
                    groups.append(i)
                    size += group.total_byte_size
                if groups and size >= self.range_bytes:
                    ranges.append(Range(name, groups))
                    groups, size = [], 0
            if groups:
                ranges.append(Range(name, groups))
        return ranges or [Range("", [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not partition.groups:
            return
        system, _ = _opened(self.folder)
        kind, keep = to_arrow_schema(self.schema), None
        for test in self.tests:
            keep = _expression(test) if keep is None else keep & _expression(test)
        with system.open_input_file(partition.file) as opened:
            file, width = pq.ParquetFile(opened), None
            for batch in file.iter_batches(8192, row_groups=partition.groups, columns=kind.names):
                table = pa.Table.from_batches([batch])
                if "vector" in kind.names:
                    width = self._width(table["vector"], width, partition.file)
                table = table if keep is None else table.filter(keep)
                yield from table.select(kind.names).cast(kind).to_batches()

    @staticmethod
    def _width(vectors: pa.ChunkedArray, width: int | None, file: str) -> int | None:
        """The length of the vectors, which must be that of those before."""
        if vectors.null_count:
            raise ValueError(f"{vectors.null_count} null vectors in {file}: embed the bundle again")
        lengths = pc.list_value_length(vectors).unique().to_pylist()
        if len(set(lengths) | ({width} if width is not None else set())) > 1:
            raise ValueError(f"vectors of unlike lengths in {file}: embed the bundle again")
        return lengths[0] if lengths else width


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def _part(self) -> tuple[str, str]:
        """The name of the part's schema, and its folder."""
        part, layout = self.options.get("part", "docs"), self.options.get("layout", "v4")
        if layout not in ("v4", "pilot") or part not in ("docs", "chunks", "edges", "vectors") or (layout, part) == ("pilot", "vectors"):
            raise ValueError(f"a {layout} bundle has no part {part}")
        return ("pilot chunks" if (layout, part) == ("pilot", "chunks") else part), (f"vectors_{self.options.get('policy', 'struct')}" if part == "vectors" else part)

    def schema(self) -> str:
        return _SCHEMAS[self._part()[0]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BundleReader(f"{self.options['path'].rstrip('/')}/{self._part()[1]}", schema, int(self.options.get("range_bytes", 64 << 20)))


def read(spark: SparkSession, path: str, part: str = "docs", **options: str) -> DataFrame:
    """A part of the bundle below the path. Registers the source with the session, and lets it take filters."""
    spark.dataSource.register(BundleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bundle").options(path=path, part=part, **options).load()


def write(path: str, docs: DataFrame, chunks: DataFrame, edges: DataFrame, vectors: dict[str, DataFrame] | None = None, rows_each: int = ROWS_EACH) -> None:
    """Writes a bundle: its tables by ranges of their paths, so that filters on paths leave whole row groups, of rows_each rows, out. Without vectors, chunks carry their own (the pilot layout)."""
    named = [("docs", "docs", docs, ("doc_type", "path")), ("chunks" if vectors is not None else "pilot chunks", "chunks", chunks, ("path", "ord")), ("edges", "edges", edges, ("src", "dst"))]
    named += [("vectors", f"vectors_{policy}", rows, ("path", "chunk_id")) for policy, rows in (vectors or {}).items()]
    for schema, folder, rows, order in named:
        kinds = StructType.fromDDL(_SCHEMAS[schema])
        cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        ranged = cast.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.write.option("parquet.block.row.count.limit", rows_each).parquet(f"{path}/{folder}")
