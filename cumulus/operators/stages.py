"""The two shared stages every mart starts from.

``group_day``: cumulative unit counts summed to one row per (date, group).  It
is the only stage that touches the large observation table; its aggregation is
partial (map-side) then final, so a hot group collapses before the shuffle, and
its output has at most one row per (group, calendar day).

``with_increments`` / ``increments``: per-group differences against the
previous *existing* row (not the previous calendar day); the first row of a
group keeps its full cumulative value.  ``increments`` drops rows whose case
increment is negative (downward corrections), and later windows run over the
surviving rows.  All per-group windows share one partitioning (group) and one
ordering (date), so Spark plans a single exchange and sort for the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cumulus.columns import OBS_COLUMNS, ObsColumns


def group_window(group: str = "state", time: str = "date") -> WindowSpec:
    return Window.partitionBy(group).orderBy(time)


def group_frame(lo: int, hi: int, calendar: bool = False) -> WindowSpec:
    """Per-group frame from ``lo`` to ``hi`` relative to the current row.

    Default: ROWS (surviving rows, the original behaviour -- after dropped
    corrections "7 rows" may span more than 7 days).  ``calendar=True``: RANGE
    over the day number, i.e. exactly the days in [d+lo, d+hi].
    """
    if calendar:
        return Window.partitionBy("state").orderBy(F.unix_date("date")).rangeBetween(lo, hi)
    return group_window().rowsBetween(lo, hi)


def group_day(obs: DataFrame, cols: ObsColumns = OBS_COLUMNS) -> DataFrame:
    """OBS -> (date, state, total_cases BIGINT, total_deaths BIGINT)."""
    return (obs.groupBy(F.col(cols.time).cast("date").alias("date"), F.col(cols.group).alias("state"))
            .agg(F.sum(cols.cases).cast("bigint").alias("total_cases"),
                 F.sum(cols.deaths).cast("bigint").alias("total_deaths")))


def _diff(col: str, w: WindowSpec):
    # Difference to the previous row; the first row keeps its own value.
    return F.coalesce(F.col(col) - F.lag(col, 1).over(w), F.col(col))


def with_increments(sd: DataFrame) -> DataFrame:
    """group-day -> + case_inc, death_inc (no rows dropped).

    A table that already carries both columns (a stage materialised with them,
    see ``plans.stage``) is returned as is, so the window runs once per stage
    instead of once per mart.
    """
    if {"case_inc", "death_inc"} <= set(sd.columns):
        return sd
    w = group_window()
    return sd.select("*", _diff("total_cases", w).alias("case_inc"),
                     _diff("total_deaths", w).alias("death_inc"))


def increments(sd: DataFrame) -> DataFrame:
    """group-day -> increments with negative case increments dropped."""
    return with_increments(sd).filter(F.col("case_inc") >= 0)
