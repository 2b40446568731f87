"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement is: fixture CTEs (observation table built from the driver's
tables) + shared stage CTEs (group-day sums, increments) + the query's own
SQL.  Written independently of the Spark code, in plain set/window SQL.

Rounding follows Spark's rule for DOUBLE: the value's shortest decimal form is
rounded half-up (41/40 = 1.025 -> 1.03), whereas DuckDB's ROUND on a DOUBLE
rounds the binary value (1.0249999... -> 1.02).  So every rounding here is
``CAST(ROUND(CAST(CAST(x AS VARCHAR) AS DECIMAL(38, 18)), n) AS DOUBLE)``:
DuckDB's DOUBLE -> VARCHAR cast gives the shortest form, and DECIMAL rounding
is half away from zero like Spark's HALF_UP.
"""

from __future__ import annotations

from cumulus.constants import REFERENCE_COORDS

FIXTURE_CTE = {
    "B1": """
d AS (SELECT CAST(ts AS DATE) AS date, 'u' || CAST(user_id % 10 AS VARCHAR) AS county,
             event_type AS state, COUNT(*) AS n, COUNT(*) FILTER (WHERE value >= 100) AS m
      FROM events GROUP BY 1, 2, 3),
obs AS (SELECT date, county, state, CAST(SUM(n) OVER w AS BIGINT) AS cases,
               CAST(SUM(m) OVER w AS BIGINT) AS deaths
        FROM d WINDOW w AS (PARTITION BY county, state ORDER BY date))""",
    "B2": """
d AS (SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS date, c.c_mktsegment AS county,
             n.n_name AS state, COUNT(*) AS n, COUNT(*) FILTER (WHERE o.o_orderstatus = 'F') AS m
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                    JOIN nation n ON c.c_nationkey = n.n_nationkey
      GROUP BY 1, 2, 3),
obs AS (SELECT date, county, state, CAST(SUM(n) OVER w AS BIGINT) AS cases,
               CAST(SUM(m) OVER w AS BIGINT) AS deaths
        FROM d WINDOW w AS (PARTITION BY county, state ORDER BY date))""",
    "B3": """
d AS (SELECT CAST(l.l_shipdate AS DATE) AS date, s.s_name AS county, n.n_name AS state,
             CAST(SUM(l.l_quantity) AS BIGINT) AS n,
             CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE 0 END) AS BIGINT) AS m
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                      JOIN nation n ON s.s_nationkey = n.n_nationkey
      GROUP BY 1, 2, 3),
obs AS (SELECT date, county, state, CAST(SUM(n) OVER w AS BIGINT) AS cases,
               CAST(SUM(m) OVER w AS BIGINT) AS deaths
        FROM d WINDOW w AS (PARTITION BY county, state ORDER BY date))""",
}

STAGES_CTE = """
sd AS (SELECT date, state, CAST(SUM(cases) AS BIGINT) AS total_cases,
              CAST(SUM(deaths) AS BIGINT) AS total_deaths
       FROM obs GROUP BY date, state),
wi AS (SELECT date, state, total_cases, total_deaths,
              COALESCE(total_cases - LAG(total_cases) OVER w, total_cases) AS case_inc,
              COALESCE(total_deaths - LAG(total_deaths) OVER w, total_deaths) AS death_inc
       FROM sd WINDOW w AS (PARTITION BY state ORDER BY date)),
inc AS (SELECT * FROM wi WHERE case_inc >= 0),
snap AS (SELECT date, state, total_cases, total_deaths,
                CAST(ROUND(CAST(CAST(CAST(total_deaths AS DOUBLE) / NULLIF(total_cases, 0) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS death_rate
         FROM sd WHERE date = (SELECT MAX(date) FROM sd)),
coords AS (SELECT n_name AS state, CAST(25 + n_nationkey AS DOUBLE) AS lat,
                  CAST(-70 - 2 * n_nationkey AS DOUBLE) AS lon
           FROM nation)"""

DAY = "strftime(date, '%Y-%m-%d')"

# query name -> (fixture, extra CTEs or "", final SELECT)
MART_SQL: dict[str, tuple[str, str, str]] = {}


def _mart(name: str, fixture: str, final: str, ctes: str = "") -> None:
    MART_SQL[name] = (fixture, ctes, final)


DT = """dt AS (SELECT date, CAST(SUM(total_cases) AS BIGINT) AS cases,
                     CAST(SUM(total_deaths) AS BIGINT) AS deaths FROM sd GROUP BY date)"""

_mart("daily_totals", "B1", "SELECT date, cases, deaths FROM dt ORDER BY date", DT)
_mart("daily_increase", "B1", """
SELECT t1.date, t1.cases - t2.cases AS case_increase, t1.deaths - t2.deaths AS death_increase
FROM dt t1 JOIN dt t2 ON t1.date = t2.date + 1 ORDER BY t1.date""", DT)
_mart("group_snapshot", "B3", "SELECT * FROM snap ORDER BY total_cases DESC, state")
_mart("top10_cases", "B3", "SELECT date, state, total_cases FROM snap ORDER BY total_cases DESC, state LIMIT 10")
_mart("top10_deaths", "B3", "SELECT date, state, total_deaths FROM snap ORDER BY total_deaths DESC, state LIMIT 10")
_mart("bottom10_cases", "B3", "SELECT date, state, total_cases FROM snap ORDER BY total_cases ASC, state LIMIT 10")
_mart("bottom10_deaths", "B3", "SELECT date, state, total_deaths FROM snap ORDER BY total_deaths ASC, state LIMIT 10")
_mart("overall_and_group_rate", "B3", """
SELECT 1 AS sort_sign, date, 'USA' AS state,
       CAST(ROUND(CAST(CAST(CAST(SUM(total_deaths) AS DOUBLE) / NULLIF(SUM(total_cases), 0) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS death_rate
FROM snap GROUP BY date
UNION ALL
SELECT 2 AS sort_sign, date, state, death_rate FROM snap""")
_mart("rolling_mean_7", "B2", f"""
SELECT state, {DAY} AS date, rolling_avg FROM (
  SELECT state, date, CAST(ROUND(CAST(CAST(AVG(case_inc) OVER (PARTITION BY state ORDER BY date
                            ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS rolling_avg
  FROM inc)""")
_mart("peak_increment", "B2", f"""
SELECT state, {DAY} AS date, case_inc FROM (
  SELECT state, date, case_inc,
         ROW_NUMBER() OVER (PARTITION BY state ORDER BY case_inc DESC, date) AS rn FROM inc)
WHERE rn = 1""")
_mart("growth_rate", "B2", f"""
SELECT state, {DAY} AS date,
       CASE WHEN y IS NULL OR y = 0 THEN 0.0
            ELSE CAST(ROUND(CAST(CAST(CAST(case_inc - y AS DOUBLE) / y AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) END AS growth_rate
FROM (SELECT state, date, case_inc, LAG(case_inc) OVER (PARTITION BY state ORDER BY date) AS y FROM inc)""")
_mart("monthly_top10", "B2", """
SELECT month, state, monthly_inc FROM (
  SELECT month, state, monthly_inc,
         ROW_NUMBER() OVER (PARTITION BY month ORDER BY monthly_inc DESC, state) AS rn
  FROM (SELECT strftime(date, '%Y-%m') AS month, state, CAST(SUM(case_inc) AS BIGINT) AS monthly_inc
        FROM inc GROUP BY 1, 2))
WHERE rn <= 10""")
_mart("weekday_profile", "B1", """
SELECT day_of_week, avg_inc FROM (
  SELECT dayofweek(date) + 1 AS day_num, strftime(date, '%a') AS day_of_week, AVG(case_inc) AS avg_inc
  FROM inc GROUP BY 1, 2)
ORDER BY day_num""")
_mart("case_fatality_series", "B2", f"""
SELECT state, {DAY} AS date, CAST(ROUND(CAST(CAST(CAST(total_deaths AS DOUBLE) / total_cases AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS cfr
FROM sd WHERE total_cases > 0""")
_mart("doubling_time", "B2", f"""
SELECT state, {DAY} AS date, doubling_time FROM (
  SELECT state, date, CASE WHEN r > 0 THEN CAST(ROUND(CAST(CAST(ln(2) / ln(1 + r) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) END AS doubling_time
  FROM (SELECT state, date,
               CAST(total_cases - LAG(total_cases) OVER w AS DOUBLE) / NULLIF(LAG(total_cases) OVER w, 0) AS r
        FROM sd WINDOW w AS (PARTITION BY state ORDER BY date)))
WHERE doubling_time IS NOT NULL""")
_mart("pareto_share", "B3", """
SELECT state, total_deaths,
       CAST(ROUND(CAST(CAST(CAST(SUM(total_deaths) OVER (ORDER BY total_deaths DESC) AS DOUBLE)
             / NULLIF((SELECT SUM(total_deaths) FROM snap), 0) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS cum_percent
FROM snap""")
_mart("lagged_correlation", "B1", """
SELECT CAST(n * sxy - sx * sy AS DOUBLE)
       / NULLIF(sqrt(CAST(n * sxx - sx * sx AS DOUBLE) * CAST(n * syy - sy * sy AS DOUBLE)), 0) AS correlation
FROM (SELECT CAST(COUNT(*) AS HUGEINT) AS n, SUM(CAST(x AS HUGEINT)) AS sx, SUM(CAST(y AS HUGEINT)) AS sy,
             SUM(CAST(x AS HUGEINT) * y) AS sxy, SUM(CAST(x AS HUGEINT) * x) AS sxx,
             SUM(CAST(y AS HUGEINT) * y) AS syy
      FROM (SELECT x, LEAD(y0, 10) OVER (ORDER BY date) AS y
            FROM (SELECT date, SUM(case_inc) AS x, SUM(death_inc) AS y0 FROM inc GROUP BY date))
      WHERE x IS NOT NULL AND y IS NOT NULL)""")
_mart("zscore_anomaly", "B2", """
SELECT date, state, case_inc,
       (CAST(case_inc AS DOUBLE) - CAST(s AS DOUBLE) / NULLIF(n, 0))
       / NULLIF(sqrt(CAST(CAST(n AS HUGEINT) * q - CAST(s AS HUGEINT) * s AS DOUBLE) / NULLIF(n * (n - 1), 0)), 0)
       AS z_score
FROM (SELECT date, state, case_inc,
             COUNT(case_inc) OVER f AS n, SUM(case_inc) OVER f AS s,
             SUM(CAST(case_inc AS HUGEINT) * case_inc) OVER f AS q
      FROM inc WINDOW f AS (PARTITION BY state ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))""")
_mart("weighted_centroid", "B2", """
SELECT date, SUM(total_cases * lat) / NULLIF(SUM(total_cases), 0) AS center_lat,
             SUM(total_cases * lon) / NULLIF(SUM(total_cases), 0) AS center_lon
FROM sd JOIN coords USING (state) GROUP BY date ORDER BY date""")
_mart("day0_alignment", "B2", """
SELECT state, CAST(date_diff('day', day0, date) AS INTEGER) AS days_since_100, total_cases, case_inc
FROM (SELECT *, MIN(CASE WHEN total_cases >= 100 THEN date END) OVER (PARTITION BY state) AS day0 FROM wi)
WHERE case_inc >= 0 AND date >= day0""")
_mart("risk_features", "B3", """
SELECT t.state, t.total_cases, t.total_deaths, m.max_daily_inc
FROM (SELECT state, total_cases, total_deaths FROM sd WHERE date = (SELECT MAX(date) FROM sd)) t
JOIN (SELECT state, MAX(case_inc) AS max_daily_inc FROM inc GROUP BY state) m ON t.state = m.state""")
_mart("reproduction_ratio", "B2", f"""
SELECT state, {DAY} AS date, Rt FROM (
  SELECT state, date, CASE WHEN l > 50 THEN CAST(ROUND(CAST(CAST(CAST(t AS DOUBLE) / l AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) END AS Rt
  FROM (SELECT state, date,
               SUM(case_inc) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t,
               SUM(case_inc) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS l
        FROM inc))
WHERE Rt IS NOT NULL""")

_mart("rolling_mean_7_calendar", "B3", f"""
SELECT state, {DAY} AS date, CAST(ROUND(CAST(CAST(AVG(case_inc) OVER (PARTITION BY state ORDER BY date
    RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS rolling_avg
FROM inc""")
_mart("zscore_anomaly_calendar", "B3", """
SELECT date, state, case_inc,
       (CAST(case_inc AS DOUBLE) - CAST(s AS DOUBLE) / NULLIF(n, 0))
       / NULLIF(sqrt(CAST(CAST(n AS HUGEINT) * q - CAST(s AS HUGEINT) * s AS DOUBLE) / NULLIF(n * (n - 1), 0)), 0)
       AS z_score
FROM (SELECT date, state, case_inc,
             COUNT(case_inc) OVER f AS n, SUM(case_inc) OVER f AS s,
             SUM(CAST(case_inc AS HUGEINT) * case_inc) OVER f AS q
      FROM inc WINDOW f AS (PARTITION BY state ORDER BY date
                            RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))""")
_mart("reproduction_ratio_calendar", "B3", f"""
SELECT state, {DAY} AS date, Rt FROM (
  SELECT state, date, CASE WHEN l > 50 THEN CAST(ROUND(CAST(CAST(CAST(t AS DOUBLE) / l AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) END AS Rt
  FROM (SELECT state, date,
               SUM(case_inc) OVER (PARTITION BY state ORDER BY date
                                   RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS t,
               SUM(case_inc) OVER (PARTITION BY state ORDER BY date
                                   RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS l
        FROM inc))
WHERE Rt IS NOT NULL""")
_mart("snapshot_as_of", "B3", """
SELECT date, state, total_cases, total_deaths,
       CAST(ROUND(CAST(CAST(CAST(total_deaths AS DOUBLE) / NULLIF(total_cases, 0) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS death_rate
FROM sd WHERE date = DATE '1997-06-16'""")
_mart("json_roundtrip", "B3", "SELECT * FROM snap")
_mart("risk_scaled_features", "B3", """
SELECT state, ROUND(total_cases / STDDEV_SAMP(total_cases) OVER (), 6) AS scaled_total_cases,
       ROUND(total_deaths / STDDEV_SAMP(total_deaths) OVER (), 6) AS scaled_total_deaths,
       ROUND(max_daily_inc / STDDEV_SAMP(max_daily_inc) OVER (), 6) AS scaled_max_daily_inc
FROM (SELECT t.state, t.total_cases, t.total_deaths, m.max_daily_inc
      FROM (SELECT state, total_cases, total_deaths FROM sd WHERE date = (SELECT MAX(date) FROM sd)) t
      JOIN (SELECT state, MAX(case_inc) AS max_daily_inc FROM inc GROUP BY state) m ON t.state = m.state)""")
_mart("normalised_aliases", "B3", """
SELECT date, CASE WHEN state = 'NATION_1' THEN 'Unknown' ELSE state END AS state, total_deaths, total_cases,
       0 AS death_rate
FROM snap""")
_mart("daily_increase_streamed", "B1", MART_SQL["daily_increase"][2], DT)
_mart("rolling_mean_7_streamed", "B1", MART_SQL["rolling_mean_7"][2])
_mart("tsv_daily_totals", "B1", "SELECT date, cases, deaths FROM dt ORDER BY date", DT)
_mart("tsv_tolerant_totals", "B1", "SELECT date, cases, deaths FROM dt ORDER BY date", DT)
_mart("tsv_rejects", "B1", r"""
SELECT CASE day(date) WHEN 1 THEN concat_ws(chr(9), '1999/13/40', county, state, cases, deaths)
                      WHEN 2 THEN concat_ws(chr(9), strftime(date, '%Y/%-m/%-d'), county, state, 'many', deaths)
                      ELSE concat_ws(chr(9), strftime(date, '%Y/%-m/%-d'), county, state) END AS raw_line
FROM obs WHERE day(date) <= 3""")
_mart("json_single_file", "B3", "SELECT row_number() OVER (ORDER BY total_cases DESC, state) - 1 AS line, * FROM snap")
_mart("sql_over_views", "B3", """
SELECT s.state, s.total_cases, MAX(i.case_inc) AS peak, CAST(SUM(i.case_inc) AS BIGINT) AS kept_increments
FROM snap s JOIN inc i ON s.state = i.state GROUP BY s.state, s.total_cases""")
_mart("reference_centroid", "B2", """
SELECT date, CAST(ROUND(CAST(CAST(center_lat AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) AS center_lat,
             CAST(ROUND(CAST(CAST(center_lon AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) AS center_lon
FROM (SELECT date, SUM(total_cases * lat) / NULLIF(SUM(total_cases), 0) AS center_lat,
                   SUM(total_cases * lon) / NULLIF(SUM(total_cases), 0) AS center_lon
      FROM sd JOIN named USING (state) GROUP BY date)""", "named (state, lat, lon) AS (VALUES " + ", ".join(
    f"('NATION_{k}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for k, (_, lat, lon) in enumerate(REFERENCE_COORDS)) + ")")

# A unit's value on a day is its latest one, on every reported day from its first one on.
_CARRIED = """
cal AS (SELECT DISTINCT date FROM obs),
un AS (SELECT county, state, MIN(date) AS first FROM obs GROUP BY county, state),
filled AS (SELECT c.date, u.state, LAST_VALUE(o.cases IGNORE NULLS) OVER w AS cases,
                  LAST_VALUE(o.deaths IGNORE NULLS) OVER w AS deaths
           FROM un u JOIN cal c ON c.date >= u.first
           LEFT JOIN obs o ON o.county = u.county AND o.state = u.state AND o.date = c.date
           WINDOW w AS (PARTITION BY u.county, u.state ORDER BY c.date)),
carried AS (SELECT date, state, CAST(SUM(cases) AS BIGINT) AS total_cases, CAST(SUM(deaths) AS BIGINT) AS total_deaths
            FROM filled GROUP BY date, state)"""
_mart("group_day_carried", "B3", "SELECT * FROM carried", _CARRIED)
_mart("daily_increase_carried", "B3", """
SELECT t1.date, t1.cases - t2.cases AS case_increase, t1.deaths - t2.deaths AS death_increase
FROM dtc t1 JOIN dtc t2 ON t1.date = t2.date + 1 ORDER BY t1.date""", _CARRIED + """,
dtc AS (SELECT date, CAST(SUM(total_cases) AS BIGINT) AS cases,
               CAST(SUM(total_deaths) AS BIGINT) AS deaths FROM carried GROUP BY date)""")
_mart("rolling_mean_7_carried", "B3", MART_SQL["rolling_mean_7"][2].replace("FROM inc)", "FROM cinc)"), _CARRIED + """,
cinc AS (SELECT * FROM (SELECT date, state, COALESCE(total_cases - LAG(total_cases) OVER w, total_cases) AS case_inc
                        FROM carried WINDOW w AS (PARTITION BY state ORDER BY date)) WHERE case_inc >= 0)""")


# k-means (R21, V20) on whole millionths of a deviation.  ``walk``: the farthest-first traversal, one step a
# round over all points; ``runs``: Lloyd rounds of every start, one row (centres, cost of those before) each.
_KM_AXES = ("total_cases", "total_deaths", "max_daily_inc")
_KM_D = "(p.z1 - {c}[1]) * (p.z1 - {c}[1]) + (p.z2 - {c}[2]) * (p.z2 - {c}[2]) + (p.z3 - {c}[3]) * (p.z3 - {c}[3])"
_KM_POINT = "[z1, z2, z3]"
_KM_NEAR = f"list_transform(c, lambda x: {_KM_D.format(c='x')})"


def _km_deviation(x: str) -> str:
    return (f"CASE WHEN COUNT(*) > 1 THEN sqrt(CAST(COUNT(*) * SUM(CAST({x} AS HUGEINT) * {x}) - SUM(CAST({x} AS HUGEINT)) "
            f"* SUM(CAST({x} AS HUGEINT)) AS DOUBLE) / (COUNT(*) * (COUNT(*) - 1))) END")


def _km_axis(x: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST(floor(CAST({x} AS DOUBLE) * 1000000.0 / {d} + 0.5) AS HUGEINT) ELSE 0 END"


def _km_mean(z: str, n: str = "COUNT(*)") -> str:
    return f"CAST(floor((2 * SUM({z}) + {n}) / CAST(2 * {n} AS DOUBLE)) AS HUGEINT)"


_KMEANS = f"""
dev AS (SELECT {", ".join(f"{_km_deviation(x)} AS d{i}" for i, x in enumerate(_KM_AXES, 1))} FROM risk_features),
pts AS (SELECT f.*, {", ".join(f"{_km_axis(x, f'd{i}')} AS z{i}" for i, x in enumerate(_KM_AXES, 1))}
        FROM risk_features f CROSS JOIN dev),
mid AS (SELECT [{", ".join(_km_mean(f"z{i}") for i in (1, 2, 3))}] AS c FROM pts),
walk AS (SELECT 1 AS step, p.state, p.z1, p.z2, p.z3, {_KM_D.format(c="m.c")} AS d,
                first_value([p.z1, p.z2, p.z3]) OVER (ORDER BY {_KM_D.format(c="m.c")}, p.state) AS seed
         FROM pts p CROSS JOIN mid m
         UNION ALL
         SELECT step + 1, state, z1, z2, z3, d, first_value([z1, z2, z3]) OVER (ORDER BY d DESC, state) AS seed
         FROM (SELECT p.step, p.state, p.z1, p.z2, p.z3, CASE WHEN p.step = 1 THEN {_KM_D.format(c="p.seed")}
                      ELSE least(p.d, {_KM_D.format(c="p.seed")}) END AS d FROM walk p)
         WHERE step < 8 QUALIFY max(d) OVER () > 0),
seeds AS (SELECT step, any_value(seed) AS seed FROM walk GROUP BY step),
runs AS (SELECT s.step AS run, 1 AS it, list(t.seed ORDER BY t.step) AS c, CAST(NULL AS HUGEINT) AS cost
         FROM seeds s JOIN seeds t ON t.step BETWEEN s.step AND s.step + 3
         WHERE s.step <= greatest(1, (SELECT MAX(step) FROM seeds) - 3) GROUP BY s.step
         UNION ALL
         SELECT run, it + 1, list(m ORDER BY j), any_value(total)
         FROM (SELECT run, it, j, any_value(before) AS before, any_value(total) AS total,
                      CASE WHEN COUNT(*) FILTER (WHERE k = j) = 0 THEN any_value(c[j])
                           ELSE [{", ".join(f"CAST(floor((2 * SUM(z{i}) FILTER (WHERE k = j) + COUNT(*) FILTER (WHERE k = j)) / CAST(2 * COUNT(*) FILTER (WHERE k = j) AS DOUBLE)) AS HUGEINT)" for i in (1, 2, 3))}] END AS m
               FROM (SELECT run, it, c, before, z1, z2, z3, k, SUM(d) OVER (PARTITION BY run) AS total, d, unnest(range(1, len(c) + 1)) AS j
                     FROM (SELECT run, it, c, cost AS before, z1, z2, z3, list_min(near) AS d, list_position(near, list_min(near)) AS k
                           FROM (SELECT r.run, r.it, r.c, r.cost, p.z1, p.z2, p.z3, {_KM_NEAR} AS near FROM runs r CROSS JOIN pts p)))
               GROUP BY run, it, j)
         GROUP BY run, it HAVING any_value(before) IS NULL OR any_value(total) < any_value(before)),
best AS (SELECT r.c FROM runs r JOIN runs n ON n.run = r.run AND n.it = r.it + 1 ORDER BY n.cost, r.run, r.it LIMIT 1),
cents AS (SELECT list(x ORDER BY x[1] * x[1] + x[2] * x[2] + x[3] * x[3], x) AS c FROM (SELECT unnest(c) AS x FROM best)),
risk_clusters AS (SELECT state, total_cases, total_deaths, max_daily_inc, CAST(list_position(near, list_min(near)) - 1 AS INTEGER) AS prediction
                  FROM (SELECT p.*, {_KM_NEAR} AS near FROM pts p CROSS JOIN cents))"""
_RISK = f"risk_features AS (\n{MART_SQL['risk_features'][2].strip()}\n),"
_mart("risk_clusters", "B3", "SELECT * FROM risk_clusters", _RISK + _KMEANS)
_mart("cluster_tiers", "B3", "SELECT *, ['low', 'medium', 'high', 'very high'][prediction + 1] AS tier FROM risk_clusters",
      _RISK + _KMEANS)


# The batch of results is the union of the single oracles, with the place in a list as rank.
def _batch_sql() -> str:
    columns = {"rank": "INTEGER", "date": "DATE", "month": "VARCHAR", "day_num": "INTEGER", "day_of_week": "VARCHAR",
               "state": "VARCHAR", "sort_sign": "INTEGER", "total_cases": "BIGINT", "total_deaths": "BIGINT",
               "death_rate": "DOUBLE", "monthly_inc": "BIGINT", "avg_inc": "DOUBLE"}
    own = {
        "daily_totals": {"date": "date", "total_cases": "cases", "total_deaths": "deaths"},
        "group_snapshot": {c: c for c in ("date", "state", "total_cases", "total_deaths", "death_rate")},
        "overall_and_group_rate": {c: c for c in ("sort_sign", "date", "state", "death_rate")},
        "monthly_top10": {"month": "month", "state": "state", "monthly_inc": "monthly_inc",
                          "rank": "row_number() OVER (PARTITION BY month ORDER BY monthly_inc DESC, state)"},
        "weekday_profile": {"day_of_week": "day_of_week", "avg_inc": "avg_inc",
                            "day_num": "list_position(['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'], day_of_week)"},
    }
    for end, way in (("top10", "DESC"), ("bottom10", "ASC")):
        for c in ("cases", "deaths"):
            own[f"{end}_{c}"] = {"date": "date", "state": "state", f"total_{c}": f"total_{c}",
                                 "rank": f"row_number() OVER (ORDER BY total_{c} {way}, state)"}
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS result, " + ", ".join(f"CAST({cols.get(c, 'NULL')} AS {t}) AS {c}" for c, t in columns.items())
        + f" FROM (\n{MART_SQL[name][2].strip()}\n)" for name, cols in own.items())


_mart("snapshot_batch", "B3", _batch_sql(), DT)


def _zscore(n: str, s: str, q: str) -> str:
    return (f"(CAST(case_inc AS DOUBLE) - CAST({s} AS DOUBLE) / NULLIF({n}, 0)) / NULLIF(sqrt(CAST(CAST({n} AS HUGEINT) * {q} "
            f"- CAST({s} AS HUGEINT) * {s} AS DOUBLE) / NULLIF({n} * ({n} - 1), 0)), 0)")


_RANGE = "RANGE BETWEEN INTERVAL {a} DAYS PRECEDING AND {b}"
_mart("zscore_frames", "B3", "SELECT date, state, case_inc, "
      + ", ".join(f"{_zscore(f'n{k}', f's{k}', f'q{k}')} AS z_{k}" for k in (7, 14, 28))
      + "\nFROM (SELECT date, state, case_inc, "
      + ", ".join(f"COUNT(case_inc) OVER f{k} AS n{k}, SUM(case_inc) OVER f{k} AS s{k}, "
                  f"SUM(CAST(case_inc AS HUGEINT) * case_inc) OVER f{k} AS q{k}" for k in (7, 14, 28))
      + "\n      FROM inc WINDOW "
      + ", ".join(f"f{k} AS (PARTITION BY state ORDER BY date {_RANGE.format(a=k, b='INTERVAL 1 DAYS PRECEDING')})" for k in (7, 14, 28))
      + ")")
_mart("reproduction_frames", "B3", "\nUNION ALL\n".join(f"""
SELECT state, {DAY} AS date, CAST({k} AS INTEGER) AS days, Rt FROM (
  SELECT state, date, CASE WHEN l > 50 THEN CAST(ROUND(CAST(CAST(CAST(t AS DOUBLE) / l AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) END AS Rt
  FROM (SELECT state, date,
               SUM(case_inc) OVER (PARTITION BY state ORDER BY date {_RANGE.format(a=k - 1, b='CURRENT ROW')}) AS t,
               SUM(case_inc) OVER (PARTITION BY state ORDER BY date {_RANGE.format(a=2 * k - 1, b=f'INTERVAL {k} DAYS PRECEDING')}) AS l
        FROM inc))
WHERE Rt IS NOT NULL""".strip() for k in (7, 14, 28)))


def statement(name: str) -> str:
    fixture, ctes, final = MART_SQL[name]
    parts = [FIXTURE_CTE[fixture].strip(), STAGES_CTE.strip()]
    if ctes:
        parts.append(ctes.strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()


def oracle_statements() -> dict[str, str]:
    return {name: statement(name) for name in MART_SQL}


# ---- views over the marts ------------------------------------------------------------
# name -> (fixture, marts used as CTEs, extra CTEs, final SELECT)
VIEW_SQL: dict[str, tuple[str, tuple[str, ...], str, str]] = {}


def _view(name: str, fixture: str, uses: tuple[str, ...], final: str, ctes: str = "") -> None:
    VIEW_SQL[name] = (fixture, uses, ctes, final)


def _case_bins(col: str, edges, labels=None) -> str:
    parts = [f"WHEN {col} IS NULL THEN NULL"]
    for i, e in enumerate(edges):
        parts.append(f"WHEN {col} <= {e!r} THEN {f'{labels[i]!r}' if labels else i}")
    last = f"{labels[len(edges)]!r}" if labels else str(len(edges))
    return "CASE " + " ".join(parts) + f" ELSE {last} END"


def _pivot_cols(value: str, chosen) -> str:
    return ", ".join(f"MAX({value}) FILTER (WHERE state = '{s}') AS \"{s}\"" for s in chosen)


def _severity_sql() -> str:
    from cumulus.constants import SEVERITY_BINS
    selects = []
    for m, (edges, labels) in SEVERITY_BINS.items():
        v = f"COALESCE(CAST({m} AS DOUBLE), 0)"
        selects.append(f"SELECT state, '{m}' AS measure, {v} AS value, "
                       f"CAST({_case_bins(v, edges)} AS INTEGER) AS bin, {_case_bins(v, edges, labels)} AS label "
                       f"FROM group_snapshot")
    return "\nUNION ALL\n".join(selects)


_CHOSEN5 = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]
_CHOSEN6 = _CHOSEN5 + ["NATION_5"]
_IN6 = ", ".join(f"'{s}'" for s in _CHOSEN6)

_view("series_peak_and_mean", "B1", ("daily_increase",), """
SELECT series, MAX(value) AS peak_value, MIN(CASE WHEN value = mx THEN date END) AS peak_date,
       AVG(value) AS mean_value
FROM (SELECT *, MAX(value) OVER (PARTITION BY series) AS mx FROM (
        SELECT date, 'case_increase' AS series, case_increase AS value FROM daily_increase
        UNION ALL SELECT date, 'death_increase', death_increase FROM daily_increase))
GROUP BY series""")
_view("severity_bins", "B3", ("group_snapshot",), "__SEVERITY__")
_view("top5_scaled", "B3", ("group_snapshot",), """
SELECT measure, rank, state, value,
       CAST(ROUND(CAST(CAST(value / CASE measure WHEN 'total_cases' THEN CAST(10000 AS DOUBLE)
                                  WHEN 'total_deaths' THEN CAST(1 AS DOUBLE)
                                  WHEN 'death_rate' THEN CAST(0.01 AS DOUBLE) END AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS display_value
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY measure ORDER BY value DESC, state) AS INTEGER) AS rank
      FROM (SELECT state, 'total_cases' AS measure, CAST(total_cases AS DOUBLE) AS value FROM group_snapshot
            UNION ALL SELECT state, 'total_deaths', CAST(total_deaths AS DOUBLE) FROM group_snapshot
            UNION ALL SELECT state, 'death_rate', COALESCE(CAST(death_rate AS DOUBLE), 0) FROM group_snapshot))
WHERE rank <= 5""")
for _m, _src in (("total_cases", "top10_cases"), ("total_deaths", "top10_deaths")):
    _view(f"top10_ex_total_{_m.split('_')[1]}", "B3", (_src,), f"""
SELECT state, {_m}, MIN({_m}) OVER () AS color_min, MAX({_m}) OVER () AS color_max
FROM (SELECT state, {_m} FROM {_src} WHERE state <> 'USA' ORDER BY {_m} DESC, state LIMIT 10)""")
_view("rate_complement", "B3", ("overall_and_group_rate",), """
SELECT 'fatal' AS category, p AS percent FROM pr
UNION ALL SELECT 'non_fatal', CAST(ROUND(CAST(CAST(CAST(100 AS DOUBLE) - p AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) FROM pr""",
      "pr AS (SELECT CAST(ROUND(CAST(CAST(death_rate * 100 AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS p FROM overall_and_group_rate "
      "WHERE state = 'USA' AND sort_sign = 1)")
_view("latest_rolling_top20", "B2", ("rolling_mean_7",), """
SELECT state, rolling_avg FROM (
  SELECT trim(state) AS state, CAST(ROUND(CAST(CAST(SUM(rolling_avg) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS rolling_avg FROM rolling_mean_7
  WHERE date = (SELECT MAX(date) FROM rolling_mean_7) GROUP BY 1)
ORDER BY rolling_avg DESC, state LIMIT 20""")
_view("peak_top15", "B2", ("peak_increment",), """
SELECT trim(state) AS state, date, case_inc FROM peak_increment ORDER BY case_inc DESC, trim(state) LIMIT 15""")
_view("growth_extremes", "B2", ("growth_rate",), """
SELECT 'bottom' AS side, state, growth_pct FROM (SELECT * FROM gl ORDER BY growth_pct ASC, state ASC LIMIT 10)
UNION ALL
SELECT 'top', state, growth_pct FROM (SELECT * FROM gl ORDER BY growth_pct DESC, state DESC LIMIT 10)""",
      "gl AS (SELECT trim(state) AS state, CAST(ROUND(CAST(CAST(growth_rate * 100 AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS growth_pct FROM growth_rate "
      "WHERE date = (SELECT MAX(date) FROM growth_rate))")
_view("month_frames", "B2", ("monthly_top10",), """
SELECT CAST(DENSE_RANK() OVER (ORDER BY month) - 1 AS INTEGER) AS month_index, month,
       CAST(ROW_NUMBER() OVER (PARTITION BY month ORDER BY monthly_inc DESC, state) AS INTEGER) AS position,
       state, monthly_inc
FROM monthly_top10""")
_view("weekday_monday_first", "B1", ("weekday_profile",), """
SELECT CAST(CASE day_of_week WHEN 'Mon' THEN 0 WHEN 'Tue' THEN 1 WHEN 'Wed' THEN 2 WHEN 'Thu' THEN 3
                             WHEN 'Fri' THEN 4 WHEN 'Sat' THEN 5 WHEN 'Sun' THEN 6 END AS INTEGER) AS position,
       day_of_week, CAST(ROUND(CAST(CAST(avg_inc AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS avg_inc,
       MAX(CAST(ROUND(CAST(CAST(avg_inc AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)) OVER () * CAST(1.2 AS DOUBLE) AS axis_max
FROM weekday_profile WHERE day_of_week IN ('Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun')""")
_view("cfr_wide", "B2", ("case_fatality_series",),
      f"SELECT date, {_pivot_cols('cfr', _CHOSEN5)} FROM case_fatality_series GROUP BY date")
_FASTEST = """fastest AS (SELECT state, date, doubling_time FROM doubling_time
  WHERE date = (SELECT MAX(date) FROM doubling_time) AND doubling_time IS NOT NULL
  ORDER BY doubling_time ASC, state LIMIT 15)"""
_view("fastest_doubling_top15", "B2", ("doubling_time",), "SELECT * FROM fastest", _FASTEST)
_view("spread_index", "B2", ("doubling_time",), """
SELECT state, doubling_time, spread_index, MIN(spread_index) OVER () AS spread_min,
       MAX(spread_index) OVER () AS spread_max
FROM (SELECT state, doubling_time, CAST(ROUND(CAST(CAST(CAST(100 AS DOUBLE) / NULLIF(doubling_time, 0) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS spread_index
      FROM fastest)""", _FASTEST)
_view("pareto_top20_cut", "B3", ("pareto_share",), """
SELECT CAST(ROW_NUMBER() OVER o AS INTEGER) AS rank, state, total_deaths,
       CAST(ROUND(CAST(CAST(cum_percent * 100 AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS percent, cum_percent >= 0.8 AS over_threshold,
       cum_percent >= 0.8 AND COALESCE(MAX(CAST(cum_percent >= 0.8 AS INTEGER)) OVER (o ROWS BETWEEN
           UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first_crossing
FROM (SELECT * FROM pareto_share ORDER BY total_deaths DESC, state LIMIT 20)
WINDOW o AS (ORDER BY total_deaths DESC, state)""")
_view("correlation_band", "B1", ("lagged_correlation",), """
SELECT r AS correlation, r * 100 AS gauge,
       CASE WHEN r * 100 IS NULL THEN NULL WHEN r * 100 <= 30 THEN 'low' WHEN r * 100 <= 70 THEN 'medium'
            ELSE 'high' END AS band
FROM (SELECT CAST(ROUND(CAST(CAST(correlation AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS r FROM lagged_correlation)""")
_view("anomaly_points", "B2", ("zscore_anomaly",), """
SELECT date, state, case_inc, z_score, COALESCE(z_score, 0) > 0.5 AS is_anomaly
FROM zscore_anomaly WHERE state = 'NATION_0'""")
_WALK = """pts AS (SELECT ROW_NUMBER() OVER (ORDER BY date) AS i, date, center_lat AS y, center_lon AS x
        FROM weighted_centroid
        WHERE center_lat IS NOT NULL AND center_lat <> 0 AND center_lon IS NOT NULL AND center_lon <> 0),
walk AS (SELECT i, date, y, x, y AS ky, x AS kx, TRUE AS kept FROM pts WHERE i = 1
         UNION ALL
         SELECT p.i, p.date, p.y, p.x,
                CASE WHEN sqrt((p.x - w.kx) * (p.x - w.kx) + (p.y - w.ky) * (p.y - w.ky)) > 1.0 THEN p.y ELSE w.ky END,
                CASE WHEN sqrt((p.x - w.kx) * (p.x - w.kx) + (p.y - w.ky) * (p.y - w.ky)) > 1.0 THEN p.x ELSE w.kx END,
                sqrt((p.x - w.kx) * (p.x - w.kx) + (p.y - w.ky) * (p.y - w.ky)) > 1.0
         FROM walk w JOIN pts p ON p.i = w.i + 1),
kp AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY date) - 1 AS INTEGER) AS seq, date, y, x FROM walk WHERE kept)"""
_view("thin_trajectory", "B2", ("weighted_centroid",),
      "SELECT seq, date, y AS center_lat, x AS center_lon FROM kp", _WALK)
_view("trajectory_segments", "B2", ("weighted_centroid",), """
SELECT a.date AS from_date, b.date AS to_date, a.y AS from_center_lat, a.x AS from_center_lon,
       b.y AS to_center_lat, b.x AS to_center_lon
FROM kp a JOIN kp b ON b.seq = a.seq + 1""", _WALK)
_view("day0_wide", "B2", ("day0_alignment",), f"""
SELECT d.days_since_100, {", ".join(f'w."{s}"' for s in _CHOSEN6)}
FROM (SELECT CAST(unnest(generate_series(0, m)) AS INTEGER) AS days_since_100
      FROM (SELECT MAX(days_since_100) AS m FROM day0_alignment)) d
LEFT JOIN (SELECT days_since_100, {_pivot_cols('total_cases', _CHOSEN6)}
           FROM day0_alignment WHERE state IN ({_IN6}) GROUP BY days_since_100) w
  ON d.days_since_100 = w.days_since_100""")
_view("day0_endpoints", "B2", ("day0_alignment",), f"""
SELECT state, COUNT(CASE WHEN total_cases <> 0 THEN 1 END) > 0 AS has_data,
       MAX(days_since_100) AS last_day, arg_max(total_cases, days_since_100) AS last_value
FROM day0_alignment WHERE state IN ({_IN6}) GROUP BY state""")
_view("rt_threshold", "B2", ("reproduction_ratio",), """
SELECT state, date, rt, rt > 1.0 AS above_one,
       COALESCE((rt > 1.0) <> LAG(rt > 1.0) OVER (PARTITION BY state ORDER BY date), FALSE) AS crossing,
       rt = MAX(rt) OVER (PARTITION BY state) AS is_max
FROM (SELECT state, date, CAST(ROUND(CAST(CAST(Rt AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE) AS rt FROM reproduction_ratio WHERE state = 'NATION_0')""")
_view("normalised_snapshot", "B3", ("group_snapshot",), """
SELECT date, COALESCE(trim(state), 'Unknown') AS state, COALESCE(total_cases, 0) AS total_cases,
       COALESCE(total_deaths, 0) AS total_deaths, COALESCE(death_rate, 0) AS death_rate
FROM group_snapshot""")
_view("daily_totals_stacked", "B1", ("daily_totals",), """
SELECT date, 'cases' AS series, cases AS value FROM daily_totals
UNION ALL SELECT date, 'deaths', deaths FROM daily_totals""")


def view_statement(name: str) -> str:
    fixture, uses, ctes, final = VIEW_SQL[name]
    parts = [FIXTURE_CTE[fixture].strip(), STAGES_CTE.strip()]
    seen = set()
    for mart in uses:
        _, mctes, mfinal = MART_SQL[mart]
        if mctes and mctes not in seen:
            seen.add(mctes)
            parts.append(mctes.strip())
        parts.append(f"{mart} AS (\n{mfinal.strip()}\n)")
    if ctes:
        parts.append(ctes.strip())
    if final == "__SEVERITY__":
        final = _severity_sql()
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()


def all_statements() -> dict[str, str]:
    out = oracle_statements()
    out.update({name: view_statement(name) for name in VIEW_SQL})
    return out


def statement_on_obs(name: str) -> str:
    """The oracle for ``name`` over a table ``obs`` provided by the caller (no fixture CTE)."""
    if name in MART_SQL:
        _, ctes, final = MART_SQL[name]
        parts = [STAGES_CTE.strip()] + ([ctes.strip()] if ctes else [])
        return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()
    fixture, uses, ctes, final = VIEW_SQL[name]
    full = view_statement(name)
    return full.replace(FIXTURE_CTE[fixture].strip() + ",\n", "", 1)
