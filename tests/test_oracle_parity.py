"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from cumulus.plans import registry as R  # noqa: E402
from oracle_check import TABLES, canon  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

QUERIES = R.queries()
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    names = set(QUERIES)
    assert set(SQL) == names


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    sc, sr = canon(df.columns, srows)
    dc, dr = canon(dcols, cur.fetchall())
    assert sc == dc
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["state", "date", "rolling_avg"]
    assert df.count() > 0


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_oracle_rounding_follows_spark(spark, duck, digits):
    """Spark rounds a DOUBLE's shortest decimal form half-up; the oracle's expression must agree."""
    from pyspark.sql import functions as F
    ids = spark.range(0, 200 * 200)
    grid = ids.select((F.col("id") / 200).cast("bigint").alias("a") + 1, (F.col("id") % 200 + 1).alias("b"))
    grid = grid.toDF("a", "b")
    s = {(r.a, r.b): r.v for r in grid.select("a", "b", F.round(F.col("a") / F.col("b"), digits).alias("v")).collect()}
    d = dict(((a, b), v) for a, b, v in duck.execute(f"""
        SELECT a, b, CAST(ROUND(CAST(CAST(CAST(a AS DOUBLE) / b AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)
        FROM (SELECT id // 200 + 1 AS a, id % 200 + 1 AS b FROM range(0, 40000) t(id))""").fetchall())
    assert s == d
    if digits == 2:
        # Plain DuckDB ROUND rounds the binary value: 41/40 -> 1.02 where Spark gives 1.03.
        plain = duck.execute("SELECT ROUND(CAST(41 AS DOUBLE) / 40, 2)").fetchone()[0]
        assert s[(41, 40)] == 1.03 and plain == 1.02
