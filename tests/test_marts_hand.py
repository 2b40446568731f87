"""Marts on the hand-made observations; expected values worked out by hand."""

import datetime as dt
import math

import pytest

from cumulus.operators import marts as M

D = lambda d: dt.date(2020, 3, d)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_daily_totals(hand_sd):
    got = rows(M.daily_totals(hand_sd), "date", "cases", "deaths")
    assert got == [(D(1), 10, 0), (D(2), 50, 1), (D(3), 100, 3), (D(4), 205, 8), (D(5), 200, 8),
                   (D(6), 320, 12), (D(7), 430, 16), (D(8), 540, 21), (D(10), 565, 23)]


def test_daily_increase_skips_days_without_predecessor(hand_sd):
    got = rows(M.daily_increase(hand_sd), "date", "case_increase", "death_increase")
    assert got == [(D(2), 40, 1), (D(3), 50, 2), (D(4), 105, 5), (D(5), -5, 0),
                   (D(6), 120, 4), (D(7), 110, 4), (D(8), 110, 5)]


def test_snapshot_rates_and_rankings(hand_sd):
    snap = rows(M.group_snapshot(hand_sd), "state", "total_cases", "total_deaths", "death_rate")
    assert snap == [("New York", 520, 21, 0.0404), ("Texas", 45, 1, 0.0222), ("Nowhere", 0, 1, None)]
    assert rows(M.top10_cases(hand_sd, n=2), "state") == [("New York",), ("Texas",)]
    # Texas and Nowhere tie on deaths: group name breaks the tie.
    assert rows(M.bottom10_deaths(hand_sd, n=2), "state") == [("Nowhere",), ("Texas",)]
    assert rows(M.bottom10_cases(hand_sd), "state", "total_cases")[0] == ("Nowhere", 0)
    rates = rows(M.overall_and_group_rate(hand_sd), "sort_sign", "state", "death_rate")
    assert rates == [(1, "USA", 0.0407), (2, "New York", 0.0404), (2, "Texas", 0.0222), (2, "Nowhere", None)]
    as_of = rows(M.group_snapshot(hand_sd, as_of="2020-03-08"), "state", "total_cases")
    assert as_of == [("New York", 500), ("Texas", 40), ("Nowhere", 0)]


def test_increments_drop_corrections_and_rolling_mean(hand_sd):
    ny = [r for r in M.rolling_mean_7(hand_sd).collect() if r.state == "New York"]
    got = sorted((r.date, r.rolling_avg) for r in ny)
    assert got == [("2020-03-01", 10.0), ("2020-03-02", 25.0), ("2020-03-03", 33.33), ("2020-03-04", 50.0),
                   ("2020-03-06", 62.0), ("2020-03-07", 70.0), ("2020-03-08", 72.86), ("2020-03-10", 74.29)]


def test_peak_takes_earliest_on_ties(hand_sd):
    got = {r.state: (r.date, r.case_inc) for r in M.peak_increment(hand_sd).collect()}
    assert got["New York"] == ("2020-03-06", 110)
    assert got["Texas"] == ("2020-03-08", 20)
    assert got["Nowhere"] == ("2020-03-01", 0)


def test_growth_rate_zero_guard(hand_sd):
    g = {(r.state, r.date): r.growth_rate for r in M.growth_rate(hand_sd).collect()}
    assert g[("New York", "2020-03-01")] == 0.0
    assert g[("New York", "2020-03-02")] == 3.0
    assert g[("New York", "2020-03-06")] == 0.1     # against 03-04: the corrected row is gone
    assert g[("New York", "2020-03-08")] == -0.1818
    assert g[("Texas", "2020-03-04")] == 0.0        # zero predecessor
    assert g[("Texas", "2020-03-07")] == -1.0
    assert g[("Texas", "2020-03-10")] == -0.75


def test_doubling_time(hand_sd):
    d = {(r.state, r.date): r.doubling_time for r in M.doubling_time(hand_sd).collect()}
    assert d[("New York", "2020-03-02")] == 0.43
    assert d[("New York", "2020-03-03")] == 1.0
    assert ("New York", "2020-03-05") not in d       # negative growth
    assert d[("New York", "2020-03-06")] == 1.52     # against the corrected 190: no filter here
    assert ("Texas", "2020-03-04") not in d          # zero predecessor
    assert d[("Texas", "2020-03-05")] == 1.0
    assert ("Texas", "2020-03-07") not in d          # no growth
    assert d[("Texas", "2020-03-10")] == 5.88
    assert not any(k[0] == "Nowhere" for k in d)


def test_case_fatality_excludes_zero_cases(hand_sd):
    c = {(r.state, r.date): r.cfr for r in M.case_fatality_series(hand_sd).collect()}
    assert c[("New York", "2020-03-10")] == 0.0404
    assert not any(k[0] == "Nowhere" for k in c)
    assert ("Texas", "2020-03-01") not in c


def test_pareto_ties_share_running_total(hand_sd):
    p = {r.state: (r.total_deaths, r.cum_percent) for r in M.pareto_share(hand_sd).collect()}
    assert p == {"New York": (21, 0.913), "Texas": (1, 1.0), "Nowhere": (1, 1.0)}


def test_zscore(hand_sd):
    z = {(r.state, r.date): r.z_score for r in M.zscore_anomaly(hand_sd).collect()}
    assert z[("New York", D(1))] is None and z[("New York", D(2))] is None
    assert z[("New York", D(3))] == pytest.approx(25 / math.sqrt(450), rel=1e-12)
    assert all(v is None for k, v in z.items() if k[0] == "Nowhere")   # deviation 0


def test_centroid_drops_unlocated_groups(spark, hand_sd):
    from cumulus.sources.dimensions import reference_coords
    c = {r.date: (r.center_lat, r.center_lon) for r in M.weighted_centroid(hand_sd, reference_coords(spark)).collect()}
    assert c[D(1)] == pytest.approx((40.71, -74.0))
    assert c[D(4)] == pytest.approx(((200 * 40.71 + 5 * 31.96) / 205, (200 * -74.0 + 5 * -99.9) / 205))


def test_day0_alignment(hand_sd):
    got = sorted(rows(M.day0_alignment(hand_sd), "state", "days_since_100", "total_cases", "case_inc"))
    assert got == [("New York", 0, 100, 50), ("New York", 1, 200, 100), ("New York", 3, 300, 110),
                   ("New York", 4, 410, 110), ("New York", 5, 500, 90), ("New York", 7, 520, 20)]


def test_monthly_and_weekday(hand_sd):
    m = rows(M.monthly_top10(hand_sd, n=2), "month", "state", "monthly_inc")
    assert m == [("2020-03", "New York", 530), ("2020-03", "Texas", 45)]
    w = {r.day_of_week: r.avg_inc for r in M.weekday_profile(hand_sd).collect()}
    # Sundays are 03-01 (NY 10, TX 0, Nowhere 0) and 03-08 (NY 90, TX 20, Nowhere 0).
    assert w["Sun"] == pytest.approx(120 / 6)


def test_risk_features_and_clusters(hand_sd):
    from cumulus.operators.clustering import cluster_tiers, risk_clusters
    f = {r.state: (r.total_cases, r.total_deaths, r.max_daily_inc) for r in M.risk_features(hand_sd).collect()}
    assert f == {"New York": (520, 21, 110), "Texas": (45, 1, 20), "Nowhere": (0, 1, 0)}
    c = {r.state: (r.prediction, r.tier) for r in cluster_tiers(risk_clusters(M.risk_features(hand_sd), k=2)).collect()}
    assert c["New York"][0] == 1 and c["New York"][1] == "medium"
    assert c["Texas"][0] == c["Nowhere"][0] == 0


def test_calendar_frames(hand_sd):
    got = {(r.state, r.date): r.rolling_avg for r in M.rolling_mean_7(hand_sd, calendar=True).collect()}
    # Days 03-04..03-10 for New York: 100, (03-05 dropped), 110, 110, 90, (no 03-09), 20.
    assert got[("New York", "2020-03-10")] == 86.0
    rows_form = {(r.state, r.date): r.rolling_avg for r in M.rolling_mean_7(hand_sd).collect()}
    assert rows_form[("New York", "2020-03-10")] == 74.29
    assert M.lagged_correlation(hand_sd, lead_rows=1, calendar=True).count() == 1


def test_sql_path_over_registered_views(spark, hand_path, hand_sd):
    from cumulus.plans.sql import register_views
    from cumulus.sources.observations import read_obs
    register_views(spark, read_obs(spark, hand_path), prefix="hand_")
    sql = spark.sql("""
        SELECT t1.date, t1.cases - t2.cases AS case_increase, t1.deaths - t2.deaths AS death_increase
        FROM (SELECT date, sum(cases) AS cases, sum(deaths) AS deaths FROM hand_obs GROUP BY date) t1
        JOIN (SELECT date, sum(cases) AS cases, sum(deaths) AS deaths FROM hand_obs GROUP BY date) t2
          ON t1.date = date_add(t2.date, 1)""")
    assert sorted(map(tuple, sql.collect())) == [tuple(r) for r in M.daily_increase(hand_sd).collect()]
    peak = spark.sql("SELECT state, max(case_inc) AS m FROM hand_increments GROUP BY state").collect()
    assert {r.state: r.m for r in peak} == {"New York": 110, "Texas": 20, "Nowhere": 0}


def test_other_column_layout(spark, hand_path, hand_sd):
    from cumulus import ObsColumns
    from cumulus.operators.stages import group_day
    from cumulus.sources.observations import read_obs
    renamed = read_obs(spark, hand_path).toDF("day", "site", "region", "a", "b")
    sd = group_day(renamed, ObsColumns(time="day", unit="site", group="region", cases="a", deaths="b"))
    assert sorted(map(tuple, sd.collect())) == sorted(map(tuple, hand_sd.collect()))


def test_bins_are_right_closed_and_contiguous(spark):
    from pyspark.sql import functions as F
    from cumulus.functions.scalar import bin_index
    from cumulus.operators.views import SEVERITY_BINS, severity_bins
    edges, labels = SEVERITY_BINS["total_cases"]
    df = spark.createDataFrame([(float(v),) for v in [0, 30000, 30000.5, 30001, 60000, 200000, 200001]], "v double")
    got = [r.b for r in df.select(bin_index("v", edges).alias("b")).collect()]
    assert got == [0, 0, 1, 1, 1, 3, 4]          # no gap between 30,000 and 30,001
    assert df.select(bin_index(F.lit(None).cast("double"), edges).alias("b")).first().b is None
    snap = spark.createDataFrame([("a", 1000, 1000, 0.03), ("b", 1001, 5001, 0.0300001)],
                                 "state string, total_cases bigint, total_deaths bigint, death_rate double")
    out = {(r.state, r.measure): r.label for r in severity_bins(snap).collect()}
    assert out[("a", "total_deaths")] == "<1k" and out[("b", "total_deaths")] == "5k-10k"
    assert out[("a", "death_rate")] == "<3%" and out[("b", "death_rate")] == "3%-5%"


def test_sql_over_registered_marts(spark, hand_sd):
    from cumulus.plans.sql import register_marts
    from cumulus.sources.dimensions import reference_coords
    names = register_marts(spark, hand_sd, reference_coords(spark), prefix="m_")
    assert "m_rolling_mean_7" in names and "m_weighted_centroid" in names and "m_risk_clusters" not in names
    top = spark.sql("SELECT date, state, total_cases FROM m_group_snapshot "
                    "ORDER BY total_cases DESC, state LIMIT 2").collect()
    assert [tuple(r) for r in top] == [tuple(r) for r in M.top10_cases(hand_sd, n=2).collect()]
    rate = spark.sql("""SELECT 1 AS sort_sign, date, 'USA' AS state,
                               round(try_divide(sum(total_deaths), sum(total_cases)), 4) AS death_rate
                        FROM m_group_snapshot GROUP BY date""").collect()
    assert rate[0].death_rate == 0.0407
    inc = spark.sql("""SELECT t1.date, t1.cases - t2.cases AS case_increase, t1.deaths - t2.deaths AS death_increase
                       FROM m_daily_totals t1 JOIN m_daily_totals t2 ON t1.date = date_add(t2.date, 1)""")
    assert sorted(map(tuple, inc.collect())) == [tuple(r) for r in M.daily_increase(hand_sd).collect()]
