"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got
        return
    expected = duck.sql(registry.ORACLES[name])
    assert (names, got) == rows(expected.columns, expected.fetchall())


def test_all_label_volumes_are_written_where_tasks_are_many(spark, duck):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = registry.QUERIES["volume_labels"](spark, DATA)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.unset(key)
    expected = duck.sql(registry.ORACLES["volume_labels"])
    assert got == rows(expected.columns, expected.fetchall())
