"""Observation tables derived from the driver's test tables.

Each fixture counts rows per (day, unit, group) and turns them into cumulative
counts with a running sum per unit, giving the OBS layout
``(date, county, state, cases, deaths)``.  A unit without a row on some day is
missing from that day's group sum, so group totals sometimes fall -- which is
what the ``case_inc >= 0`` rule of the increments stage exists for.

Scale notes: the fact table is summed to (day, join key) before it meets its
dimension, so a key holding a third of all rows collapses map-side to one row
per day before any exchange.  No join carries a hint: AQE picks the strategy
from the sizes it measures.  The running-sum window is partitioned by unit; one
partition holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cumulate(daily: DataFrame) -> DataFrame:
    """(date, county, state, n, m) -> running sums per (county, state) ordered by date."""
    w = (Window.partitionBy("county", "state").orderBy("date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return daily.select(
        "date", "county", "state",
        F.sum("n").over(w).cast("bigint").alias("cases"),
        F.sum("m").over(w).cast("bigint").alias("deaths"),
    )


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: daily, dense.  unit = 'u' || user_id % 10, group = event_type."""
    ev = _table(spark, sf_dir, "events")
    daily = (ev.groupBy(F.to_date("ts").alias("date"),
                        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("county"),
                        F.col("event_type").alias("state"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.count(F.when(F.col("value") >= 100, 1)).alias("m")))
    return _cumulate(daily)


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: monthly.  unit = market segment, group = customer's nation."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("date"),
        F.when(F.col("o_orderstatus") == "F", 1).alias("_f"))
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = (_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("c_mktsegment").alias("county"), F.col("n_name").alias("state")))
    per_cust = orders.groupBy("o_custkey", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count("_f").alias("m"))
    daily = (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
             .groupBy("date", "county", "state").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    return _cumulate(daily)


def obs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily over ~7 years.  unit = supplier name, group = supplier's nation."""
    li = _table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), "l_suppkey", "l_quantity",
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("_r"))
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supp = (_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", F.col("s_name").alias("county"), F.col("n_name").alias("state")))
    per_supp = li.groupBy("date", "l_suppkey").agg(
        F.sum("l_quantity").alias("n"), F.sum("_r").alias("m"))
    daily = (per_supp.join(supp, per_supp.l_suppkey == supp.s_suppkey)
             .groupBy("date", "county", "state")
             .agg(F.sum("n").cast("bigint").alias("n"), F.sum("m").cast("bigint").alias("m")))
    return _cumulate(daily)


#: Tables that a fixture reads.
FIXTURE_TABLES = {"B1": ["events"], "B2": ["orders", "customer", "nation"], "B3": ["lineitem", "supplier", "nation"]}
FIXTURES = {"B1": obs_events, "B2": obs_orders, "B3": obs_lineitem}
