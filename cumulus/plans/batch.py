"""Nine results from one pass over the group-day stage.

The snapshot, its four lists, the rates, the daily totals, the monthly list and
the weekday profile all derive from four small groupings of the stage: by group,
by day, by month and group, and by weekday.  One aggregate with grouping sets makes them
(a map-side combine, one exchange), so the stage is scanned once.  The rows are
then tagged with the results that they belong to; a single window ranks all
lists at once, as a ``WindowGroupLimit`` that keeps a few rows per list in each
task before the exchange.  ``result_of`` gives one result with its own columns
and order.

    batch = stage_table(spark, snapshot_batch(sd), "batch")
    top = result_of(batch, "top10_cases")
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.constants import OVERALL_LABEL, TOP_N
from cumulus.functions.scalar import month_key, ratio
from cumulus.operators.stages import with_increments

SLICES = 64  # slices of the groups that learn the latest day; every day's row goes to each

def _order(*keys: str) -> list[tuple[str, bool]]:
    return [(k.lstrip("-"), k.startswith("-")) for k in keys]


# name -> (columns of the result, its order as (column, descending))
_LAYOUT = {
    "daily_totals": (["date", "total_cases AS cases", "total_deaths AS deaths"], _order("date")),
    "group_snapshot": (["date", "state", "total_cases", "total_deaths", "death_rate"], _order("-total_cases", "state")),
    "top10_cases": (["date", "state", "total_cases"], _order("rank")),
    "top10_deaths": (["date", "state", "total_deaths"], _order("rank")),
    "bottom10_cases": (["date", "state", "total_cases"], _order("rank")),
    "bottom10_deaths": (["date", "state", "total_deaths"], _order("rank")),
    "overall_and_group_rate": (["sort_sign", "date", "state", "death_rate"], _order("sort_sign", "-death_rate", "state")),
    "monthly_top10": (["month", "state", "monthly_inc"], _order("month", "rank")),
    "weekday_profile": (["day_of_week", "avg_inc"], _order("day_num")),
}
NAMES = tuple(_LAYOUT)


def _tag(result: str, score: str | None = None, overall: str | None = None) -> Column:
    """A result that a row belongs to, and for lists what its place goes by (the higher, the earlier)."""
    return F.struct(F.lit(result).alias("result"), (F.expr(score) if score else F.lit(None)).cast("decimal(20,0)").alias("score"),
                    F.lit(score is not None).alias("listed"), F.lit(overall).alias("overall"))


def snapshot_batch(sd: DataFrame, n: int = TOP_N, overall_label: str = OVERALL_LABEL) -> DataFrame:
    """(result, rank, date, month, day_num, day_of_week, state, sort_sign, total_cases, total_deaths, death_rate,
    monthly_inc, avg_inc): the rows of all ``NAMES``; columns that a result does not have are null.

    ``rank`` is the place in a list.  Days, groups and measures follow the single
    marts: the latest day of all, increments that are not negative, ties by group.
    """
    wi = with_increments(sd).select(
        "date", "state", "total_cases", "total_deaths", month_key("date").alias("month"),
        F.dayofweek("date").alias("day_num"), F.date_format("date", "E").alias("day_of_week"),
        F.when(F.col("case_inc") >= 0, F.col("case_inc")).alias("case_inc"))
    keys = ["state", "date", "month", "day_num", "day_of_week"]
    grouped = wi.groupingSets([["state"], ["date"], ["month", "state"], ["day_num", "day_of_week"]], *keys).agg(
        *[F.grouping(k).alias(f"_g_{k}") for k in keys],
        F.max(F.struct(F.col("date").alias("d"), F.col("total_cases").alias("c"), F.col("total_deaths").alias("x"))).alias("_last"),
        F.sum("total_cases").cast("bigint").alias("_cases"), F.sum("total_deaths").cast("bigint").alias("_deaths"),
        F.sum("case_inc").cast("bigint").alias("_inc"), F.count("case_inc").alias("_n"))
    # A column is a key of the row's grouping where its flag is 0.
    level = (F.when(F.col("_g_month") == 0, F.lit("month")).when(F.col("_g_day_num") == 0, F.lit("weekday"))
             .when(F.col("_g_date") == 0, F.lit("day")).otherwise(F.lit("group")))
    rows = grouped.select(level.alias("level"), *keys, "_last", "_cases", "_deaths", "_inc", "_n")
    rows = rows.where("level IN ('group', 'day') OR _n > 0")
    # Each slice of the groups also gets every day (one row a calendar day), so it knows the latest.
    rows = rows.withColumn("slice", F.explode(F.when(F.col("level") == "day", F.sequence(F.lit(0), F.lit(SLICES - 1)))
                                              .otherwise(F.array(F.pmod(F.xxhash64("level", *keys), F.lit(SLICES)).cast("int")))))
    latest = F.max(F.when(F.col("level") == "day", F.col("date"))).over(Window.partitionBy("slice"))
    rows = rows.withColumn("latest", latest).where("(level != 'day' OR slice = 0) AND (level != 'group' OR _last.d = latest)")
    is_group = F.col("level") == "group"
    rows = rows.select(
        "level", "latest", "month", "day_num", "day_of_week", "state",
        F.when(is_group, F.col("_last.d")).otherwise(F.col("date")).alias("date"),
        F.when(is_group, F.col("_last.c")).when(F.col("level") == "day", F.col("_cases")).alias("total_cases"),
        F.when(is_group, F.col("_last.x")).when(F.col("level") == "day", F.col("_deaths")).alias("total_deaths"),
        F.when(F.col("level") == "month", F.col("_inc")).alias("monthly_inc"),
        F.when(F.col("level") == "weekday", F.try_divide(F.col("_inc").cast("double"), F.col("_n").cast("double"))).alias("avg_inc"))
    lists = [_tag("top10_cases", "total_cases"), _tag("top10_deaths", "total_deaths"),
             _tag("bottom10_cases", "-total_cases"), _tag("bottom10_deaths", "-total_deaths")]
    tags = (F.when(is_group, F.array(_tag("group_snapshot"), _tag("overall_and_group_rate"), *lists))
            .when((F.col("level") == "day") & (F.col("date") == F.col("latest")),
                  F.array(_tag("daily_totals"), _tag("overall_and_group_rate", overall=overall_label)))
            .when(F.col("level") == "day", F.array(_tag("daily_totals")))
            .when(F.col("level") == "month", F.array(_tag("monthly_top10", "monthly_inc")))
            .otherwise(F.array(_tag("weekday_profile"))))
    rows = rows.withColumn("tag", F.explode(tags)).select("tag.*", *[c for c in rows.columns if c != "level"])
    # Rows of no list are lists of one: their own keys name them.
    alone = F.when(~F.col("listed"), F.struct("state", "date", "day_num", "overall"))
    place = Window.partitionBy("result", "month", alone).orderBy(F.col("score").desc_nulls_last(), "state")
    ranked = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)
    whole = F.col("overall").isNotNull()
    rate = F.round(ratio("total_deaths", "total_cases"), 4)
    rated = F.col("result").isin("group_snapshot", "overall_and_group_rate")
    shown = {  # the results that show a measure
        "total_cases": F.col("result").isin("daily_totals", "group_snapshot", "top10_cases", "bottom10_cases"),
        "total_deaths": F.col("result").isin("daily_totals", "group_snapshot", "top10_deaths", "bottom10_deaths")}
    return ranked.select(
        "result", F.when(F.col("listed"), F.col("rank")).alias("rank"), "date", "month", "day_num", "day_of_week",
        F.when(whole, F.col("overall")).otherwise(F.col("state")).alias("state"),
        F.when(F.col("result") == "overall_and_group_rate", F.when(whole, 1).otherwise(2)).alias("sort_sign"),
        *[F.when(on, F.col(c)).alias(c) for c, on in shown.items()], F.when(rated, rate).alias("death_rate"),
        "monthly_inc", "avg_inc")


def result_of(batch: DataFrame, name: str) -> DataFrame:
    """One result of the batch, with the columns, types and order of its mart."""
    columns, order = _LAYOUT[name]
    keys = [F.col(k).desc_nulls_last() if down else F.col(k).asc() for k, down in order]
    return batch.where(F.col("result") == name).orderBy(*keys).selectExpr(*columns)
