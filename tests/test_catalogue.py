"""Every plan against its SQL twin on the smallest tables, and under another partitioning."""

import os
from pathlib import Path

import pytest

import __spark_entry__
from allelic.plans.catalogue import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def told(v):
    if isinstance(v, float):
        return "None" if v != v else repr(round(v, 6) + 0.0)
    return str(v)


def lines(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(told(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert lines(df.columns, rows) == lines(names, result.fetchall())


@pytest.mark.parametrize("name", ["sample_summary", "overlay_plan_chain", "noise_model", "ancestry_tracts", "ld_decay"])
def test_partitions_do_not_matter(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, str(DATA))
        found.append(lines(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_python_in_plans(spark):
    for name in ("sample_summary", "variant_scan", "ld_decay", "golden_bed"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
