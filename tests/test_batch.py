import re

import pytest

from cumulus.operators import marts as M
from cumulus.plans import batch as B
from cumulus.plans import registry as R

from conftest import SF_SMALL


@pytest.fixture(scope="module", params=["B2", "B3"])
def stage(spark, request):
    return R.staged_group_day(spark, SF_SMALL, request.param)


def test_the_batch_reads_the_stage_once(stage):
    df = B.snapshot_batch(stage)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet|Scan parquet", plan)) == 1
    assert "WindowGroupLimit" in plan and "Expand" in plan
    assert "SinglePartition" not in plan and "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", B.NAMES)
def test_every_result_equals_its_mart(stage, name):
    want = getattr(M, name)(stage)
    got = B.result_of(B.snapshot_batch(stage), name)
    assert got.dtypes == want.dtypes
    rows = list(map(tuple, got.collect()))
    if name == "monthly_top10":  # the mart leaves its order open
        assert sorted(rows) == sorted(map(tuple, want.collect()))
    else:
        assert rows == list(map(tuple, want.collect()))


def test_hand_data_and_no_rows(spark, hand_sd):
    for sd in (hand_sd, hand_sd.limit(0)):
        made = B.snapshot_batch(sd).cache()
        for name in B.NAMES:
            got, want = (sorted(map(repr, df.collect())) for df in (B.result_of(made, name), getattr(M, name)(sd)))
            assert got == want, name


def test_run_all_writes_the_same_from_the_batch(spark, tmp_path):
    from cumulus.plans.pipeline import run_fixture
    written = run_fixture(spark, SF_SMALL, str(tmp_path / "out"), fixture="B3", fmt="parquet", names=B.NAMES)
    for name, path in written.items():
        got = sorted(map(repr, spark.read.parquet(path).collect()))
        want = sorted(map(repr, getattr(M, name)(R.staged_group_day(spark, SF_SMALL, "B3")).collect()))
        assert got == want, name
