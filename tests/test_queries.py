"""Every query against its SQL on the smallest tables."""

import math
import os

import pytest

from docloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        connection.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return connection


@needs_tables
@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query(spark, duck, key):
    found = catalog.queries()[key](spark, SF)
    rows, columns = found.collect(), sorted(found.columns)
    sql = catalog.oracle_sql().get(key)
    if sql is None:
        assert columns
        return
    answer = duck.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want


def test_entry_names_are_the_catalogs():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_ranking_does_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = catalog.queries()["bm25_topk"](spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(one) == sorted(catalog.queries()["bm25_topk"](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@needs_tables
def test_approximate_neighbours_are_the_nearest(spark):
    keys = lambda name: {(r.query_id, r.unit_id) for r in catalog.queries()[name](spark, SF).collect()}
    found, exact = keys("ann_lsh"), keys("dense_topk")
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
