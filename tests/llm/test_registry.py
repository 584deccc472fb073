"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from docloom.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "pages", "labels")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        files = sorted(glob.glob(f"{SF}/{name}.parquet/*.parquet")) or [f"{SF}/{name}.parquet"]
        connection.read_parquet(files).create_view(name)
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, key):
    found = registry.queries()[key](spark, SF)
    answer = duck.execute(registry.oracle_sql()[key])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(found.columns)
    want = answer.fetchall()
    got = [tuple(r) for r in found.select(*names).collect()]
    assert len(got) == len(want) and sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_is_registered_under_its_number():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.queries()) == list(range(1, 14))
