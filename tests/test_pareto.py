"""The running share against a plain window, under every setting that a slice must not depend on."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cumulus.operators.pareto import running_share_desc


def plain(df):
    w = Window.orderBy(F.col("v").desc_nulls_last())
    return df.select("state", "v", F.round(F.sum("v").over(w).cast("double") / F.sum("v").over(Window.partitionBy()), 4).alias("cum_percent"))


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_many_distinct_values_and_a_hot_zero(spark, reuse, adaptive):
    names = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(400_000, numPartitions=8)
        df = ids.select(F.col("id").alias("state"), F.pmod(F.xxhash64("id"), F.lit(10_000_000)).alias("v")).unionByName(
            spark.range(400_000, 600_000).select(F.col("id").alias("state"), F.lit(0).cast("long").alias("v"))).unionByName(
            spark.range(600_000, 600_010).select(F.col("id").alias("state"), F.lit(None).cast("long").alias("v")))
        got = running_share_desc(df, "v")
        total = df.agg(F.sum("v")).first()[0]
        peers = df.groupBy("v").agg(F.sum("v").alias("m")).orderBy(F.col("v").desc_nulls_last()).collect()
        run, want = 0, {}
        for r in peers:
            run += r.m or 0
            want[r.v] = run / total
        rows = got.collect()
        assert len(rows) == 600_010
        assert max(abs(r.cum_percent - want[r.v]) for r in rows) <= 0.5001e-4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_tables(spark):
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 5), ("d", 0), ("e", 10)], "state string, v long")
    assert sorted(map(tuple, running_share_desc(df, "v").collect())) == sorted(map(tuple, plain(df).collect()))
    assert running_share_desc(df.limit(0), "v").count() == 0
    nulls = df.where("v IS NULL")
    assert [tuple(r) for r in running_share_desc(nulls, "v").collect()] == [("b", None, None)]
