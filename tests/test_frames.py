import random

import pytest

from cumulus.operators import frames as FR
from cumulus.operators import marts as M
from cumulus.plans import registry as R

from conftest import SF_SMALL

DAYS = (3, 7, 14, 28)


@pytest.fixture(scope="module")
def stage(spark):
    return R.staged_group_day(spark, SF_SMALL, "B3")


def test_zscores_equal_the_single_calendar_frames(stage):
    got = {(r.date, r.state): r for r in FR.zscore_frames(stage, DAYS).collect()}
    for k in DAYS:
        want = M.zscore_anomaly(stage, rows=k, calendar=True).collect()
        assert len(want) == len(got)
        assert all(got[r.date, r.state][f"z_{k}"] == r.z_score and got[r.date, r.state].case_inc == r.case_inc for r in want)


def test_ratios_equal_the_single_calendar_frames(stage):
    got = sorted(tuple(r) for r in FR.reproduction_frames(stage, DAYS).collect())
    want = sorted((r.state, r.date, k, r.Rt) for k in DAYS for r in M.reproduction_ratio(stage, rows=k, calendar=True).collect())
    assert got == want and len({r[2] for r in want}) == len(DAYS)


def test_moments_of_any_frame(spark):
    draw = random.Random(6)
    rows = [(s, f"2021-{m:02d}-{d:02d}", draw.choice([None, draw.randrange(-10 ** 9, 10 ** 9)]))
            for s in ("a", "b") for m in (1, 2) for d in range(1, 29) if draw.random() < 0.6]
    df = spark.createDataFrame(rows, "state string, day string, v long").selectExpr("state", "CAST(day AS DATE) AS date", "v")
    frames = {"own": (0, 0), "week": (6, 0), "gap": (20, 11)}
    got = FR.frame_moments(df, "v", frames).collect()
    table = [(r.state, r.date, r.v) for r in df.collect()]
    assert len(got) == len(table)
    for r in got:
        for name, (a, b) in frames.items():
            inside = [v for s, d, v in table if s == r.state and b <= (r.date - d).days <= a and v is not None]
            assert (r[f"{name}_n"], r[f"{name}_s"], int(r[f"{name}_q"])) == (len(inside), sum(inside), sum(v * v for v in inside))
    assert FR.frame_moments(df.limit(0), "v", frames).count() == 0


@pytest.mark.parametrize("build", [FR.zscore_frames, FR.reproduction_frames])
def test_all_lengths_share_one_sort_and_no_exchange_on_the_stage(stage, build):
    def shape(days):
        plan = build(stage, days)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange"), plan.count("Sort ["), plan.count("Window [")

    assert shape((7,)) == shape((7, 14, 28, 56)) == (0, 1, 1)


def test_one_exchange_without_a_stage(hand_sd):
    plan = FR.zscore_frames(hand_sd)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemory")[0].count("Exchange hashpartitioning") == 1
