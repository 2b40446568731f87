"""Plan shape: exchanges, top-k limits, pushdown, and no Python in the hot path."""

import pytest

from cumulus.plans import registry as R

from conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapCoGroupsInPandas", "PythonUDF")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


WINDOW_MARTS = ["rolling_mean_7", "zscore_anomaly", "reproduction_ratio", "growth_rate"]


@pytest.mark.parametrize("name", WINDOW_MARTS)
def test_group_windows_need_no_exchange_on_the_bucketed_stage(spark, name):
    plan = plan_of(R.run(name, spark, SF_SMALL))
    assert "Exchange" not in plan
    assert plan.count("Sort [state") == 1


@pytest.mark.parametrize("name", WINDOW_MARTS)
def test_group_windows_share_one_exchange_on_a_plain_stage(spark, name):
    from cumulus.plans.stage import stage_table
    sd = stage_table(spark, R.group_day_of(spark, SF_SMALL, "B2"), "plain")
    plan = plan_of(R.REGISTRY[name][1](spark, SF_SMALL, sd))
    assert plan.count("Exchange hashpartitioning(state") == 1
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["peak_increment", "monthly_top10"])
def test_topk_per_group_uses_window_group_limit(spark, name):
    assert "WindowGroupLimit" in plan_of(R.run(name, spark, SF_SMALL))


def test_no_python_in_any_registered_plan(spark):
    for name, fn in R.queries().items():
        plan = plan_of(fn(spark, SF_SMALL))
        assert not any(n in plan for n in PYTHON_NODES), name


def test_group_filter_reaches_the_scan(spark):
    plan = plan_of(R.run("anomaly_points", spark, SF_SMALL))
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "EqualTo(state,NATION_0)" in pushed          # the group filter
    assert "GreaterThanOrEqual(case_inc,0)" in pushed   # the correction filter, on the staged increments
    assert "SelectedBucketsCount: 1 out of" in plan      # bucket pruning on the group


def test_fixture_scans_prune_columns(spark):
    plan = plan_of(R.group_day_of(spark, SF_SMALL, "B3"))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


def test_group_day_aggregates_before_its_exchange(spark):
    from cumulus.operators.stages import group_day
    from cumulus.sources.observations import read_obs
    import conftest
    import tempfile, os
    d = tempfile.mkdtemp(prefix="cumulus-plan-")
    path = os.path.join(d, "obs.tsv")
    open(path, "w").write(conftest.HAND_TSV)
    plan = plan_of(group_day(read_obs(spark, path)))
    partial = plan.find("partial_sum")
    exchange = plan.find("Exchange hashpartitioning(")
    # The tree string lists parents first: the exchange sits above the partial aggregate.
    assert partial > exchange > 0


@pytest.mark.parametrize("fixture", ["B2", "B3"])
def test_fixture_joins_carry_no_hint(spark, fixture):
    from cumulus.sources import fixtures as FX
    df = FX.FIXTURES[fixture](spark, SF_SMALL)
    logical = df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in logical and "UnresolvedHint" not in logical


@pytest.mark.parametrize("partitions, buckets", [(8, None), (520, None), (8, 16)])
def test_stage_build_has_one_exchange_by_group(spark, partitions, buckets):
    from cumulus.operators.stages import with_increments
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        sd = R.group_day_of(spark, SF_SMALL, "B3")
        plan = plan_of(with_increments(sd.repartition(buckets or partitions, "state")))
        assert plan.count("Exchange hashpartitioning(state") == 1
        staged = R.stage_group_days(spark, sd=sd, buckets=buckets)
        assert "Exchange" not in plan_of(R.REGISTRY["rolling_mean_7"][1](spark, SF_SMALL, staged))
        assert len(staged.inputFiles()) <= (buckets or partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stage_is_made_again_when_its_source_changes(spark, tmp_path):
    import shutil
    shutil.copyfile(f"{SF_SMALL}/events.parquet", tmp_path / "events.parquet")
    first = R.run("daily_totals", spark, str(tmp_path)).count()
    assert first == R.run("daily_totals", spark, str(tmp_path)).count()
    half = spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(1)
    half.write.parquet(str(tmp_path / "new"))
    part = next((tmp_path / "new").glob("part-*.parquet"))
    shutil.copyfile(part, tmp_path / "events.parquet")
    assert R.run("daily_totals", spark, str(tmp_path)).count() == 1 < first


def test_stages_go_with_the_application(spark, tmp_path):
    from cumulus.plans import stage as S
    path = S.new_path(spark, "cumulus_probe")
    spark.range(3).write.parquet(path)
    own = S._WRITTEN[spark.sparkContext.applicationId]
    others = [p for p in own if p != path]
    own[:] = [path]
    try:
        assert S.drop_stages(spark) == 1
        with pytest.raises(Exception):
            spark.read.parquet(path).count()
    finally:
        S._WRITTEN[spark.sparkContext.applicationId] = others


def test_bucketed_stage_leaves_no_catalog_table(spark):
    from cumulus.plans.stage import stage_table
    before = {t.name for t in spark.catalog.listTables()}
    sd = stage_table(spark, R.group_day_of(spark, SF_SMALL, "B1"), "probe", bucket_by="state")
    assert {t.name for t in spark.catalog.listTables()} == before
    plan = plan_of(R.REGISTRY["rolling_mean_7"][1](spark, SF_SMALL, sd))
    assert "Exchange" not in plan


def test_stage_falls_back_to_plain_files_without_a_catalog(spark, monkeypatch):
    from pyspark.errors import AnalysisException
    from pyspark.sql import DataFrameWriter
    from cumulus.plans.stage import stage_table

    def refuse(self, *a, **k):
        raise AnalysisException("no catalog")

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", refuse)
    sd = stage_table(spark, R.group_day_of(spark, SF_SMALL, "B1"), "fallback", bucket_by="state")
    want = sorted(map(tuple, R.group_day_of(spark, SF_SMALL, "B1").collect()))
    assert sorted(map(tuple, sd.collect())) == want
    assert "Bucketed: true" not in plan_of(sd)


def test_stage_raises_what_is_no_refusal_of_the_catalog(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from cumulus.plans.stage import stage_table

    def fail(self, *a, **k):
        raise RuntimeError("disk full")

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", fail)
    with pytest.raises(RuntimeError):
        stage_table(spark, R.group_day_of(spark, SF_SMALL, "B1"), "failing", bucket_by="state")
