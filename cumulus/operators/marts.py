"""Result tables R1-R22, each a function of the group-day table ``sd``.

``sd = group_day(obs)`` is the only input: every mart, including the per-day
national ones, is derived from it (a sum over units per day equals the sum over
groups of the group sums).  A pipeline can therefore materialise ``sd`` once
and run every mart from it.

Output columns and types follow the original result files; dates leave as
``yyyy-MM-dd`` strings where the originals wrote strings.  Ratios use
``try_divide`` so a zero denominator gives NULL under ANSI mode.  Ties in
rankings are broken by group then date so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.constants import (
    DAY0_THRESHOLD, LEAD_ROWS, OVERALL_LABEL, ROLLING_ROWS, RT_FLOOR, RT_ROWS, TOP_N, TRAILING_ROWS,
)
from cumulus.functions.scalar import day_string, doubling_days, month_key, ratio
from cumulus.operators.pareto import running_share_desc
from cumulus.operators.ranking import top_n, top_per_group
from cumulus.operators.stages import group_frame, group_window, increments, with_increments
from cumulus.operators.stats import lead_pairs, pearson, trailing_zscore


def latest_date(sd: DataFrame) -> Column:
    """max(date) as a scalar subquery (no collect to the driver)."""
    return sd.agg(F.max("date")).scalar()


def _as_of(sd: DataFrame, as_of) -> Column:
    return latest_date(sd) if as_of is None else F.lit(as_of).cast("date")


# ---- R1-R8: calendar totals and the as-of snapshot --------------------------------

def daily_totals(sd: DataFrame, ordered: bool = True) -> DataFrame:
    """(date, cases, deaths), sums over all groups per day."""
    out = sd.groupBy("date").agg(F.sum("total_cases").cast("bigint").alias("cases"),
                                 F.sum("total_deaths").cast("bigint").alias("deaths"))
    return out.orderBy("date") if ordered else out


def daily_increase(sd: DataFrame) -> DataFrame:
    """R2: today minus the calendar day before; days without a predecessor are absent."""
    days = Window.orderBy("date")  # one row per calendar day
    before = [F.lag(c, 1).over(days).alias(f"_{c}") for c in ("date", "cases", "deaths")]
    return (daily_totals(sd, ordered=False).select("*", *before)
            .filter(F.datediff("date", "_date") == 1)
            .select("date", (F.col("cases") - F.col("_cases")).alias("case_increase"),
                    (F.col("deaths") - F.col("_deaths")).alias("death_increase"))
            .orderBy("date"))


def group_snapshot(sd: DataFrame, as_of=None, ordered: bool = True) -> DataFrame:
    """Per group on the as-of day (default: latest day): totals and death rate."""
    out = (sd.filter(F.col("date") == _as_of(sd, as_of))
           .select("date", "state", "total_cases", "total_deaths",
                   F.round(ratio("total_deaths", "total_cases"), 4).alias("death_rate")))
    return out.orderBy(F.col("total_cases").desc(), "state") if ordered else out


def top10_cases(sd: DataFrame, as_of=None, n: int = TOP_N) -> DataFrame:
    """R4."""
    return top_n(group_snapshot(sd, as_of, False).select("date", "state", "total_cases"), "total_cases", n)


def top10_deaths(sd: DataFrame, as_of=None, n: int = TOP_N) -> DataFrame:
    """R5."""
    return top_n(group_snapshot(sd, as_of, False).select("date", "state", "total_deaths"), "total_deaths", n)


def bottom10_cases(sd: DataFrame, as_of=None, n: int = TOP_N) -> DataFrame:
    """R6."""
    return top_n(group_snapshot(sd, as_of, False).select("date", "state", "total_cases"),
                 "total_cases", n, ascending=True)


def bottom10_deaths(sd: DataFrame, as_of=None, n: int = TOP_N) -> DataFrame:
    """R7."""
    return top_n(group_snapshot(sd, as_of, False).select("date", "state", "total_deaths"),
                 "total_deaths", n, ascending=True)


def overall_and_group_rate(sd: DataFrame, as_of=None, overall_label: str = OVERALL_LABEL) -> DataFrame:
    """One overall row (sort_sign 1) followed by every group's rate (sort_sign 2)."""
    day = sd.filter(F.col("date") == _as_of(sd, as_of))
    # One pass: the group-day table has one row per group on a day, so the rollup's
    # finer level is the groups and its coarser one the overall row.
    levels = day.rollup("date", "state").agg(
        F.grouping("state").alias("_overall"), F.grouping("date").alias("_all_days"),
        F.round(ratio(F.sum("total_deaths"), F.sum("total_cases")), 4).alias("death_rate"))
    overall = F.col("_overall") == 1
    return (levels.filter(F.col("_all_days") == 0)
            .select(F.when(overall, 1).otherwise(2).alias("sort_sign"), "date",
                    F.when(overall, F.lit(overall_label)).otherwise(F.col("state")).alias("state"), "death_rate")
            .orderBy("sort_sign", F.col("death_rate").desc_nulls_last(), "state"))


# ---- R9-R13: windows over the surviving increments -------------------------------

def rolling_mean_7(sd: DataFrame, rows: int = ROLLING_ROWS, calendar: bool = False) -> DataFrame:
    """Mean of the last <= ``rows`` surviving increments (or days), 2 dp."""
    w = group_frame(-(rows - 1), 0, calendar)
    return increments(sd).select("state", day_string("date").alias("date"),
                                 F.round(F.avg("case_inc").over(w), 2).alias("rolling_avg"))


def peak_increment(sd: DataFrame) -> DataFrame:
    """The single largest increment per group (earliest day on ties)."""
    peak = top_per_group(increments(sd), "state", "case_inc", 1, tiebreak=("date",))
    return peak.select("state", day_string("date").alias("date"), "case_inc")


def growth_rate(sd: DataFrame) -> DataFrame:
    """(inc - previous inc) / previous inc, 4 dp; 0 when there is no usable previous."""
    y = F.lag("case_inc", 1).over(group_window())
    inc = increments(sd).withColumn("_y", y)
    g = (F.when(F.col("_y").isNull() | (F.col("_y") == 0), F.lit(0.0))
         .otherwise(F.round(ratio(F.col("case_inc") - F.col("_y"), F.col("_y")), 4)))
    return inc.select("state", day_string("date").alias("date"), g.alias("growth_rate"))


def monthly_top10(sd: DataFrame, n: int = TOP_N) -> DataFrame:
    """Increments summed per (month, group); the n largest per month."""
    monthly = (increments(sd).groupBy(month_key("date").alias("month"), "state")
               .agg(F.sum("case_inc").cast("bigint").alias("monthly_inc")))
    return top_per_group(monthly, "month", "monthly_inc", n).select("month", "state", "monthly_inc")


def weekday_profile(sd: DataFrame, national: bool = False) -> DataFrame:
    """Mean increment per weekday over group-days, Sunday first.

    ``national=True`` averages the national daily sums instead of group-days.
    """
    inc = increments(sd)
    if national:
        inc = inc.groupBy("date").agg(F.sum("case_inc").alias("case_inc"))
    return (inc
            .groupBy(F.dayofweek("date").alias("day_num"), F.date_format("date", "E").alias("day_of_week"))
            .agg(F.avg("case_inc").alias("avg_inc"))
            .orderBy("day_num").select("day_of_week", "avg_inc"))


# ---- R14-R16: ratios of the cumulative series -------------------------------------

def case_fatality_series(sd: DataFrame) -> DataFrame:
    """Deaths / cases per group-day, 4 dp, where cases > 0."""
    return (sd.filter(F.col("total_cases") > 0)
            .select("state", day_string("date").alias("date"),
                    F.round(ratio("total_deaths", "total_cases"), 4).alias("cfr")))


def doubling_time(sd: DataFrame) -> DataFrame:
    """ln2 / ln(1 + r) for r = relative growth of the cumulative, only r > 0, 2 dp.

    Runs on the cumulative series with no increment filter.
    """
    prev = F.lag("total_cases", 1).over(group_window())
    r = ratio(F.col("total_cases") - prev, prev)
    return (sd.select("state", day_string("date").alias("date"), doubling_days(r).alias("doubling_time"))
            .filter(F.col("doubling_time").isNotNull()))


def pareto_share(sd: DataFrame, as_of=None) -> DataFrame:
    """Latest-day deaths per group with the running share in descending order, 4 dp."""
    last = sd.filter(F.col("date") == _as_of(sd, as_of)).select("state", "total_deaths")
    return running_share_desc(last, "total_deaths").select("state", "total_deaths", "cum_percent")


# ---- R17-R22 -------------------------------------------------------------------------

def lagged_correlation(sd: DataFrame, lead_rows: int = LEAD_ROWS, calendar: bool = False) -> DataFrame:
    """Pearson r between national increments at row t and death increments at row t + lead.

    ``calendar=True`` pairs day d with day d + lead instead (an equi-join on the
    shifted date, no ordered window).
    """
    national = (increments(sd).groupBy("date")
                .agg(F.sum("case_inc").alias("nat_case_inc"), F.sum("death_inc").alias("nat_death_inc")))
    if calendar:
        a, b = national.alias("a"), national.alias("b")
        pairs = a.join(b, F.col("b.date") == F.date_add(F.col("a.date"), lead_rows)).select(
            F.col("a.nat_case_inc").alias("nat_case_inc"), F.col("b.nat_death_inc").alias("nat_death_inc_lagged"))
    else:
        pairs = lead_pairs(national, "nat_case_inc", "nat_death_inc", lead_rows)
    return pairs.agg(pearson("nat_case_inc", "nat_death_inc_lagged").alias("correlation"))


def zscore_anomaly(sd: DataFrame, rows: int = TRAILING_ROWS, calendar: bool = False) -> DataFrame:
    """Z-score of each increment against the ``rows`` preceding surviving rows (or days)."""
    inc = increments(sd).select("date", "state", "case_inc")
    return trailing_zscore(inc, "case_inc", group_frame(-rows, -1, calendar))


def weighted_centroid(sd: DataFrame, coords: DataFrame, with_coverage: bool = False) -> DataFrame:
    """Case-weighted mean position of the located groups per day.

    ``coords`` is a (state, lat, lon) dimension.  Groups without coordinates
    drop out (inner join).  ``with_coverage=True`` adds the share of
    the day's cases that the located groups carry (left join, same pass).
    """
    if not with_coverage:
        geo = sd.join(coords, "state")
        return (geo.groupBy("date")
                .agg(ratio(F.sum(F.col("total_cases") * F.col("lat")), F.sum("total_cases")).alias("center_lat"),
                     ratio(F.sum(F.col("total_cases") * F.col("lon")), F.sum("total_cases")).alias("center_lon"))
                .orderBy("date"))
    geo = sd.join(coords, "state", "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    w = F.when(located, F.col("total_cases"))
    return (geo.groupBy("date")
            .agg(ratio(F.sum(w * F.col("lat")), F.sum(w)).alias("center_lat"),
                 ratio(F.sum(w * F.col("lon")), F.sum(w)).alias("center_lon"),
                 ratio(F.sum(w), F.sum("total_cases")).alias("coverage"),
                 F.count(w).alias("_located"))
            .filter(F.col("_located") > 0).drop("_located")
            .orderBy("date"))


def day0_alignment(sd: DataFrame, threshold: int = DAY0_THRESHOLD) -> DataFrame:
    """Surviving rows on or after each group's first day with cumulative >= threshold.

    Day 0 comes from the same per-group window as the increments (no join).
    """
    whole = group_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    day0 = F.min(F.when(F.col("total_cases") >= threshold, F.col("date"))).over(whole)
    return (with_increments(sd).withColumn("_day0", day0)
            .filter(F.col("case_inc") >= 0)
            .withColumn("days_since_100", F.datediff("date", "_day0"))
            .filter(F.col("days_since_100") >= 0)
            .select("state", "days_since_100", "total_cases", "case_inc"))


def risk_features(sd: DataFrame, as_of=None) -> DataFrame:
    """R21 features: latest totals per group joined with its largest surviving increment."""
    wi = with_increments(sd)
    totals = wi.filter(F.col("date") == _as_of(sd, as_of)).select("state", "total_cases", "total_deaths")
    peak = wi.filter(F.col("case_inc") >= 0).groupBy("state").agg(F.max("case_inc").alias("max_daily_inc"))
    return totals.join(peak, "state").select("state", "total_cases", "total_deaths", "max_daily_inc")


def reproduction_ratio(sd: DataFrame, rows: int = RT_ROWS, floor: int = RT_FLOOR, calendar: bool = False) -> DataFrame:
    """Sum of the last ``rows`` increments over the ``rows`` before them, 2 dp,
    only where the earlier sum exceeds ``floor``."""
    sums = increments(sd).select(
        "state", "date",
        F.sum("case_inc").over(group_frame(-(rows - 1), 0, calendar)).alias("_this"),
        F.sum("case_inc").over(group_frame(-(2 * rows - 1), -rows, calendar)).alias("_last"))
    rt = F.when(F.col("_last") > floor, F.round(ratio("_this", "_last"), 2))
    return (sums.select("state", day_string("date").alias("date"), rt.alias("Rt"))
            .filter(F.col("Rt").isNotNull()))
