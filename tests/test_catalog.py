"""Every registered query against its SQL in DuckDB, on the smallest of the driver's tables."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__
from kmerscape.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.12g}" if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_is_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["file_id", "seq_id", "pos", "freq"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_exact_plan_reads_two_columns_and_broadcasts_no_sequences(spark):
    plan = catalog.QUERIES["freq_e0_both"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "NestedLoop" not in plan
    # only the few hot k-mers may be broadcast, never all
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 1
