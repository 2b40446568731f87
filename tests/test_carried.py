"""Totals with silent units carried forward, against a plain walk over units and days."""

import datetime as dt
import random

import pytest

from cumulus.columns import ObsColumns
from cumulus.operators import marts as M
from cumulus.operators.carried import carried_totals, group_day_carried, unit_steps

OBS = "date date, county string, state string, cases long, deaths long"
D = [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in range(40)]


def by_hand(rows, every_day=False):
    """{(day, group): (cases, deaths)}: each unit's latest values, summed on every day from the group's first one on."""
    rows = [r for r in rows if r[0] is not None]
    days = sorted({r[0] for r in rows})
    if every_day and days:
        days = [days[0] + dt.timedelta(days=k) for k in range((days[-1] - days[0]).days + 1)]
    out, latest = {}, {}
    for day in days:
        today = {}
        for d, unit, group, *values in rows:
            if d == day:
                sums = today.setdefault((unit, group), [None, None])
                for k, v in enumerate(values):
                    if v is not None:
                        sums[k] = (sums[k] or 0) + v
        for key, sums in today.items():
            old = latest.get(key, (0, 0))
            latest[key] = tuple(o if s is None else s for s, o in zip(sums, old))
        for group in {g for _, g in latest}:
            held = [v for (_, g), v in latest.items() if g == group]
            out[day, group] = tuple(map(sum, zip(*held)))
    return out


def totals(df):
    return {(r.date, r.state): (r.total_cases, r.total_deaths) for r in df.collect()}


def test_a_silent_unit_keeps_its_value(spark):
    rows = [(D[0], "a", "x", 10, 1), (D[0], "b", "x", 5, 0), (D[1], "a", "x", 12, 1), (D[2], "b", "x", 6, 0), (D[2], "c", "y", 1, 0)]
    sd = group_day_carried(spark.createDataFrame(rows, OBS))
    assert totals(sd) == {(D[0], "x"): (15, 1), (D[1], "x"): (17, 1), (D[2], "x"): (18, 1), (D[2], "y"): (1, 0)}
    assert [(r.date, r.case_increase, r.death_increase) for r in M.daily_increase(sd).collect()] == [(D[1], 2, 0), (D[2], 2, 0)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("every_day", [False, True])
def test_random_tables_in_any_layout(spark, seed, every_day):
    """Gaps, corrections, nulls in every column, repeated rows, days on which nobody reports."""
    rnd = random.Random(seed)
    rows = []
    for unit, group in [("a", "x"), ("b", "x"), (None, "x"), ("a", "y"), ("a", None), ("d", "z")]:
        value = 0
        for day in D[rnd.randrange(10):]:
            if rnd.random() < 0.4 or day in D[20:23]:
                continue
            value = max(0, value + rnd.choice([0, 1, 5, 9, -3]))
            rows.append((day, unit, group, rnd.choice([value, value, None]), rnd.choice([value // 9, None])))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    rows.append((None, "a", "x", 1000, 1000))
    want = by_hand(rows, every_day)
    df = spark.createDataFrame(rows, OBS).selectExpr("*", "'e' AS total_cases", "'u' AS unit")
    for parts in (1, 7):
        assert totals(group_day_carried(df.repartition(parts), every_day=every_day)) == want


def test_no_fall_that_is_due_to_a_gap(spark):
    """Values that never fall give totals that never fall, whichever units are silent."""
    rnd, rows = random.Random(5), []
    for u in range(8):
        value = 0
        for day in D:
            value += rnd.randrange(4)
            if rnd.random() < 0.5:
                rows.append((day, f"u{u}", f"g{u % 2}", value, value // 3))
    sd = group_day_carried(spark.createDataFrame(rows, OBS))
    assert M.daily_increase(sd).where("case_increase < 0 OR death_increase < 0").count() == 0
    assert sd.count() >= 2 * len(D) - 4


def test_empty_and_other_names(spark):
    assert group_day_carried(spark.createDataFrame([], OBS)).count() == 0
    other = spark.createDataFrame([(D[0], "s", "r", 3, 1)], "day date, site string, region string, a long, b long")
    names = ObsColumns(time="day", unit="site", group="region", cases="a", deaths="b")
    assert totals(group_day_carried(other, names)) == {(D[0], "r"): (3, 1)}


def test_one_window_over_units_and_none_over_all_rows(spark):
    steps = unit_steps(spark.createDataFrame([(D[0], "a", "x", 1, 1)], OBS))
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "Python" not in plan and "SinglePartition" not in plan
    later = carried_totals(steps)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in later and "NestedLoop" not in later
