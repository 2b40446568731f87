"""Ordered scans over range partitions against plain windows in one task."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cumulus.operators import marts as M
from cumulus.operators.ordered import running_sums, shifted

SETTINGS = [("true", "true"), ("false", "true"), ("true", "false"), ("false", "false")]


@pytest.fixture(params=SETTINGS, ids=lambda s: f"reuse={s[0]},adaptive={s[1]}")
def settings(spark, request):
    names = dict(zip(("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled"), request.param))
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def table(spark, n, seed=1):
    draw = random.Random(seed)
    rows = [(k, draw.choice([None, draw.randrange(-50, 1000)]), draw.randrange(10)) for k in range(n)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "k long, v long, w int").repartition(5)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_running_sums(spark, settings):
    df = table(spark, 3000)
    got = running_sums(df, [F.col("k").desc()], {"run": F.col("v"), "place": F.lit(1)}, slices=7)
    assert got.columns == ["k", "v", "w", "run", "place", "run_total", "place_total"]
    w = Window.orderBy(F.col("k").desc())
    want = df.select("k", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("run"), F.row_number().over(w).alias("place"),
                     F.sum("v").over(Window.partitionBy()).alias("run_total"), F.lit(3000).alias("place_total"))
    columns = ["k", "run", "place", "run_total", "place_total"]
    assert rows_of(got, *columns) == rows_of(want, *columns)


@pytest.mark.parametrize("rows", [1, 10, -3, 0])
def test_leads_and_lags_cross_blocks(spark, settings, rows, monkeypatch):
    from cumulus.operators import ordered
    monkeypatch.setattr(ordered, "BLOCK", 16)
    df = table(spark, 500)
    got = shifted(df, [F.col("k")], rows, {"later": "v"})
    w = Window.orderBy("k")
    want = df.withColumn("later", F.lead("v", rows).over(w) if rows >= 0 else F.lag("v", -rows).over(w))
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select("k", "v", "later").collect()), key=key) == \
        sorted(map(tuple, want.select("k", "v", "later").collect()), key=key)


def test_a_shift_longer_than_the_table_and_empty_tables(spark):
    df = table(spark, 5)
    assert {r.later for r in shifted(df, [F.col("k")], 9, {"later": "w"}).collect()} == {None}
    assert running_sums(df.limit(0), [F.col("k")], {"run": F.col("v")}).count() == 0
    assert shifted(df.limit(0), [F.col("k")], 2, {"later": "v"}).count() == 0
    only = running_sums(df.where("k = 3").withColumn("v", F.lit(None).cast("long")), [F.col("k")], {"run": F.col("v")}).first()
    assert (only.run, only.run_total) == (0, 0)


def test_building_runs_no_job_and_no_task_holds_all_rows(spark, hand_sd):
    sc = spark.sparkContext
    sc.setJobGroup("build", "building plans")
    try:
        share, correlation = M.pareto_share(hand_sd), M.lagged_correlation(hand_sd, lead_rows=1)
        assert list(sc.statusTracker().getJobIdsForGroup("build")) == []
    finally:
        sc.setJobGroup("tests", "")
    for df in (share, correlation):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "- Window [" in line or "+- Window" in line]
        assert windows and all(any(c in line for c in ("_slice", "_to", "_block", "state")) for line in windows)
        assert "rangepartitioning" in plan


def test_slices_share_the_rows(spark):
    df = spark.range(80_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    ranged = df.repartitionByRange(8, "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 20_000
    got = running_sums(df, [F.col("k")], {"run": F.col("v")}, slices=8)
    assert got.where("run != k + 1").isEmpty()
