"""Data-shaping views over the marts (V1-V23), as DataFrame operators.

These are the steps the original chart notebook did in single-machine Python
after reading result files; here each is a Spark operator over the mart's
DataFrame, with deterministic tie-breaks (group name) where Python relied on
file order.  Views that pick "chosen" groups take them as a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.constants import (
    ANOMALY_Z, AXIS_HEADROOM, CORRELATION_BANDS, FASTEST_TOP_N, OVERALL_LABEL, PARETO_CUT, PARETO_TOP_N,
    PEAK_TOP_N, ROLLING_TOP_N, RT_LEVEL, SEVERITY_BINS, TOP5_DIVISORS, TOP5_N, TOP_N, WEEK_ORDER,
)
from cumulus.functions.scalar import bin_index, pct, ratio
from cumulus.operators.ranking import top_n, top_per_group

def _label(idx_col, labels: Sequence[str]):
    return F.element_at(F.array(*[F.lit(s) for s in labels]), idx_col + 1)


def _unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "measure",
             value: str = "value", cast: str | None = None) -> DataFrame:
    src = df.select(*ids, *[F.col(v).cast(cast).alias(v) if cast else F.col(v) for v in values])
    return src.unpivot(list(ids), list(values), name, value)


def _latest(df: DataFrame, col: str = "date") -> DataFrame:
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())


# V1 -----------------------------------------------------------------------------------
def series_peak_and_mean(increase: DataFrame) -> DataFrame:
    """Peak (earliest day on ties) and mean of each daily-increase series."""
    long = _unpivot(increase, ["date"], ["case_increase", "death_increase"], "series", "value")
    return long.groupBy("series").agg(
        F.max("value").alias("peak_value"),
        F.min_by("date", F.struct(F.negative("value"), F.col("date"))).alias("peak_date"),
        F.avg("value").alias("mean_value"))


# V2 -----------------------------------------------------------------------------------
def severity_bins(snapshot: DataFrame, bins: Mapping = SEVERITY_BINS) -> DataFrame:
    """Every measure of every group in its bin; a missing measure counts as 0."""
    long = _unpivot(snapshot, ["state"], list(bins), cast="double").fillna(0.0, subset=["value"])
    idx = F.lit(None).cast("int")
    lab = F.lit(None).cast("string")
    for measure, (edges, labels) in bins.items():
        b = bin_index("value", edges)
        idx = F.when(F.col("measure") == measure, b).otherwise(idx)
        lab = F.when(F.col("measure") == measure, _label(b, labels)).otherwise(lab)
    return long.select("state", "measure", "value", idx.alias("bin"), lab.alias("label"))


# V3 -----------------------------------------------------------------------------------
def top5_scaled(snapshot: DataFrame, n: int = TOP5_N, divisors: Mapping = TOP5_DIVISORS) -> DataFrame:
    """The n largest groups of every measure; a missing measure counts as 0."""
    long = _unpivot(snapshot, ["state"], list(divisors), cast="double").fillna(0.0, subset=["value"])
    ranked = top_per_group(long, "measure", "value", n, rank_col="rank")
    div = F.lit(None).cast("double")
    for m, d in divisors.items():
        div = F.when(F.col("measure") == m, F.lit(d)).otherwise(div)
    return ranked.select("measure", "rank", "state", "value",
                         F.round(ratio("value", div), 2).alias("display_value"))


# V4 -----------------------------------------------------------------------------------
def top10_ex_total(top: DataFrame, measure: str, n: int = TOP_N, overall_label: str = OVERALL_LABEL) -> DataFrame:
    """Drop the overall row, keep the n largest, add the colour-scale bounds."""
    best = top_n(top.filter(F.col("state") != overall_label).select("state", measure), measure, n)
    everything = Window.partitionBy()  # at most n rows, already in one partition after the limit
    return best.select("state", measure, F.min(measure).over(everything).alias("color_min"),
                       F.max(measure).over(everything).alias("color_max"))


# V5 -----------------------------------------------------------------------------------
def rate_complement(rates: DataFrame, overall_label: str = OVERALL_LABEL) -> DataFrame:
    """National death rate in % and its complement, as two rows."""
    p = pct("death_rate")
    one = rates.filter((F.col("state") == overall_label) & (F.col("sort_sign") == 1)).select(p.alias("p"))
    pairs = F.array(F.struct(F.lit("fatal").alias("category"), F.col("p").alias("percent")),
                    F.struct(F.lit("non_fatal").alias("category"), F.round(F.lit(100.0) - F.col("p"), 2).alias("percent")))
    return one.select(F.inline(pairs))


# V6 -----------------------------------------------------------------------------------
def latest_rolling_top20(rolling: DataFrame, n: int = ROLLING_TOP_N) -> DataFrame:
    last = _latest(rolling).select(F.trim("state").alias("state"), "rolling_avg")
    summed = last.groupBy("state").agg(F.round(F.sum("rolling_avg"), 2).alias("rolling_avg"))
    return top_n(summed, "rolling_avg", n)


# V7 -----------------------------------------------------------------------------------
def peak_top15(peaks: DataFrame, n: int = PEAK_TOP_N) -> DataFrame:
    return top_n(peaks.select(F.trim("state").alias("state"), "date", "case_inc"), "case_inc", n)


# V8 -----------------------------------------------------------------------------------
def growth_extremes(growth: DataFrame, n: int = TOP_N) -> DataFrame:
    """Latest day: the n lowest and the n highest growth rates in % (overlap kept)."""
    last = _latest(growth).select(F.trim("state").alias("state"), pct("growth_rate").alias("growth_pct"))
    # A group can be on both sides; each side is a limit of its own over the day's rows.
    sides = last.withColumn("side", F.explode(F.array(F.lit("bottom"), F.lit("top"))))
    signed = sides.withColumn("_by", F.when(F.col("side") == "top", -F.col("growth_pct")).otherwise(F.col("growth_pct")))
    order = [F.col("_by").asc_nulls_last(), F.when(F.col("side") == "bottom", F.col("state")).asc(), F.col("state").desc()]
    ranked = signed.withColumn("_rn", F.row_number().over(Window.partitionBy("side").orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).select("side", "state", "growth_pct")


# V9 -----------------------------------------------------------------------------------
def month_frames(monthly: DataFrame) -> DataFrame:
    """Months in order (0-based index) and the groups ranked inside each month.

    The month index is a dense rank over the monthly top-k table, which holds at
    most k rows per month.
    """
    pos = F.row_number().over(Window.partitionBy("month").orderBy(F.col("monthly_inc").desc(), "state"))
    idx = F.dense_rank().over(Window.orderBy("month")) - 1
    return monthly.select(idx.cast("int").alias("month_index"), "month", pos.alias("position"),
                          "state", "monthly_inc")


# V10 ----------------------------------------------------------------------------------
def weekday_monday_first(profile: DataFrame, headroom: float = AXIS_HEADROOM) -> DataFrame:
    names = F.array(*[F.lit(d) for d in WEEK_ORDER])
    kept = profile.filter(F.col("day_of_week").isin(WEEK_ORDER)).select(
        (F.array_position(names, F.col("day_of_week")) - 1).cast("int").alias("position"),
        "day_of_week", F.round("avg_inc", 2).alias("avg_inc"))
    return kept.withColumn("axis_max", F.max("avg_inc").over(Window.partitionBy()) * F.lit(headroom))


# V11 ----------------------------------------------------------------------------------
def cfr_wide(cfr: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Chosen groups as columns over every date of the series; missing = NULL."""
    return cfr.groupBy("date").pivot("state", list(chosen)).agg(F.max("cfr"))


# V12, V13 -----------------------------------------------------------------------------
def fastest_doubling_top15(doubling: DataFrame, n: int = FASTEST_TOP_N) -> DataFrame:
    last = _latest(doubling).filter(F.col("doubling_time").isNotNull())
    return top_n(last.select("state", "date", "doubling_time"), "doubling_time", n, ascending=True)


def spread_index(fastest: DataFrame) -> DataFrame:
    everything = Window.partitionBy()  # at most 15 rows after the top-k limit
    s = F.round(ratio(F.lit(100.0), "doubling_time"), 2)
    return (fastest.select("state", "doubling_time", s.alias("spread_index"))
            .withColumn("spread_min", F.min("spread_index").over(everything))
            .withColumn("spread_max", F.max("spread_index").over(everything)))


# V14 ----------------------------------------------------------------------------------
def pareto_top20_cut(pareto: DataFrame, n: int = PARETO_TOP_N, cut: float = PARETO_CUT) -> DataFrame:
    top = top_n(pareto, "total_deaths", n)
    order = Window.orderBy(F.col("total_deaths").desc(), "state")  # over at most n rows
    over = F.col("cum_percent") >= F.lit(cut)
    crossed_before = F.coalesce(F.max(over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0))
    return top.select(F.row_number().over(order).alias("rank"), "state", "total_deaths",
                      pct("cum_percent").alias("percent"), over.alias("over_threshold"),
                      (over & (crossed_before == 0)).alias("first_crossing"))


# V15 ----------------------------------------------------------------------------------
def correlation_band(corr: DataFrame, bands=CORRELATION_BANDS) -> DataFrame:
    r = F.round("correlation", 4)
    edges, labels = bands
    g = r * F.lit(100)
    return corr.select(r.alias("correlation"), g.alias("gauge"), _label(bin_index(g, edges), labels).alias("band"))


# V16 ----------------------------------------------------------------------------------
def anomaly_points(z: DataFrame, state: str, threshold: float = ANOMALY_Z) -> DataFrame:
    return (z.filter(F.col("state") == state)
            .select("date", "state", "case_inc", "z_score",
                    (F.coalesce(F.col("z_score"), F.lit(0.0)) > F.lit(threshold)).alias("is_anomaly")))


# V19 ----------------------------------------------------------------------------------
def day0_wide(aligned: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Days 0..max over all groups; one column of cumulative counts per chosen group.

    The day axis is generated from the largest day (one row per day).
    """
    axis = aligned.agg(F.max("days_since_100").alias("m")).select(
        F.explode(F.sequence(F.lit(0), F.col("m"))).alias("days_since_100"))
    wide = (aligned.filter(F.col("state").isin(list(chosen)))
            .groupBy("days_since_100").pivot("state", list(chosen)).agg(F.max("total_cases")))
    return axis.join(wide, "days_since_100", "left")


def day0_endpoints(aligned: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Per chosen group with rows: whether it has a non-zero value, its last day and value."""
    return (aligned.filter(F.col("state").isin(list(chosen))).groupBy("state")
            .agg((F.count(F.when(F.col("total_cases") != 0, 1)) > 0).alias("has_data"),
                 F.max("days_since_100").alias("last_day"),
                 F.max_by("total_cases", "days_since_100").alias("last_value")))


# V21 ----------------------------------------------------------------------------------
def rt_threshold(rt: DataFrame, state: str, level: float = RT_LEVEL) -> DataFrame:
    w = Window.partitionBy("state").orderBy("date")
    one = rt.filter(F.col("state") == state).select("state", "date", F.round("Rt", 3).alias("rt"))
    above = F.col("rt") > F.lit(level)
    prev = F.lag(above, 1).over(w)
    return one.select("state", "date", "rt", above.alias("above_one"),
                      F.coalesce(above != prev, F.lit(False)).alias("crossing"),
                      (F.col("rt") == F.max("rt").over(Window.partitionBy("state"))).alias("is_max"))


# V22 ----------------------------------------------------------------------------------
def normalise(df: DataFrame, measures: Mapping[str, Sequence[str]] | None = None,
              group: str = "state", unknown: str = "Unknown") -> DataFrame:
    """Tolerant reading of result rows: trimmed group name ('Unknown' when missing),
    measures taken from the first present spelling, 0 when missing or absent altogether."""
    measures = measures or {"total_cases": ["totalCases"], "total_deaths": ["totalDeaths"],
                            "death_rate": ["deathRate"]}
    cols = set(df.columns)
    out = df
    if group in cols:
        out = out.withColumn(group, F.coalesce(F.trim(F.col(group)), F.lit(unknown)))
    else:
        out = out.withColumn(group, F.lit(unknown))
    for name, alts in measures.items():
        present = [F.col(c) for c in [name, *alts] if c in cols]
        out = out.withColumn(name, F.coalesce(*present, F.lit(0)))
        out = out.drop(*[a for a in alts if a in cols])
    return out


# V23 ----------------------------------------------------------------------------------
def daily_totals_stacked(totals: DataFrame) -> DataFrame:
    return _unpivot(totals, ["date"], ["cases", "deaths"], "series", "value")
