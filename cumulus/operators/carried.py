"""Group-day totals in which a unit that is silent on a day keeps its last value.

The plain group-day sum counts the units that report on a day, so a silent unit
makes its group's total fall.  Here every unit's latest value counts, as if each
unit had been merged as of every day of the calendar.  That calendar of units is
never built: a unit's rows become steps (the value less the last one known), steps
are summed to one row per (day, group), and a group's running sum of steps is the
sum of its units' latest values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.columns import OBS_COLUMNS, ObsColumns

TOTALS = ("total_cases", "total_deaths")


def unit_steps(obs: DataFrame, cols: ObsColumns = OBS_COLUMNS) -> DataFrame:
    """OBS -> (date, state, total_cases, total_deaths): by how much the units' latest values change on a day they report.

    Several rows of a unit and day are summed first, as in the plain group-day table.
    A null measure leaves the unit's last value as it is; rows without a day are left
    out; rows without unit (or group) belong to one unit (or group) without name.
    This is the only part that reads the observations.  A window partition holds one
    row per calendar day of one unit.
    """
    day = obs.where(F.col(cols.time).cast("date").isNotNull()).groupBy(
        F.col(cols.time).cast("date").alias("date"), F.col(cols.unit).alias("unit"), F.col(cols.group).alias("state")).agg(
        *[F.sum(c).cast("bigint").alias(t) for c, t in zip((cols.cases, cols.deaths), TOTALS)])
    earlier = (Window.partitionBy("state", "unit").orderBy("date")
               .rowsBetween(Window.unboundedPreceding, -1))

    def step(c: str) -> Column:
        return F.coalesce(F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(earlier), F.lit(0)), F.lit(0))

    steps = day.select("date", "state", *[step(c).alias(c) for c in TOTALS])
    return steps.groupBy("date", "state").agg(*[F.sum(c).cast("bigint").alias(c) for c in TOTALS])


def carried_totals(steps: DataFrame, every_day: bool = False) -> DataFrame:
    """Steps -> group-day table: each group's total on every reported day from its first one on.

    Reported days are those on which any unit of any group reports; ``every_day``
    takes all calendar days up to the last one instead.  ``steps`` is read several
    times, so give a written table (``plans.stage.stage_table``) where it is dear to make.
    """
    last = steps.agg(F.max("date")).scalar()
    calendar = steps.groupBy("state").agg(F.min("date").alias("first")).select(
        F.explode(F.sequence(F.col("first"), last)).alias("date"), "state")
    if not every_day:
        calendar = calendar.join(steps.select("date").distinct(), "date", "left_semi")
    silent = calendar.select("date", "state", *[F.lit(0).cast("bigint").alias(c) for c in TOTALS])
    days = steps.select("date", "state", *TOTALS).unionByName(silent).groupBy("date", "state").agg(
        *[F.sum(c).alias(c) for c in TOTALS])
    upto = Window.partitionBy("state").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select("date", "state", *[F.sum(c).over(upto).cast("bigint").alias(c) for c in TOTALS])


def group_day_carried(obs: DataFrame, cols: ObsColumns = OBS_COLUMNS, every_day: bool = False) -> DataFrame:
    """OBS -> (date, state, total_cases, total_deaths) with silent units carried forward."""
    return carried_totals(unit_steps(obs, cols), every_day)
