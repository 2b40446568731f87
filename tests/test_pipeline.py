import json


def test_run_tsv_writes_every_mart(spark, hand_path, tmp_path):
    from cumulus.plans.pipeline import run_tsv
    out = str(tmp_path / "out")
    written = run_tsv(spark, hand_path, out)
    assert "daily_totals" in written and "weighted_centroid" in written and "risk_clusters" in written
    parts = sorted((tmp_path / "out" / "daily_totals").glob("part-*.json"))
    assert len(parts) == 1
    lines = [json.loads(x) for x in parts[0].read_text().splitlines() if x.strip()]
    assert [x["date"] for x in lines] == sorted(x["date"] for x in lines)
    assert lines[-1] == {"date": "2020-03-10", "cases": 565, "deaths": 23}
    z = [json.loads(x) for p in (tmp_path / "out" / "zscore_anomaly").glob("part-*.json")
         for x in p.read_text().splitlines() if x.strip()]
    assert any(r["z_score"] is None for r in z) and all("z_score" in r for r in z)


def test_checkpoint_dir_prefers_session_setting(spark):
    from cumulus.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_run_fixture_parquet_output_matches_queries(spark, tmp_path):
    from cumulus.plans import registry as R
    from cumulus.plans.pipeline import run_fixture
    from conftest import SF_SMALL
    written = run_fixture(spark, SF_SMALL, str(tmp_path / "out"), fixture="B2", fmt="parquet",
                          names=["rolling_mean_7", "weighted_centroid", "pareto_share"])
    assert set(written) == {"rolling_mean_7", "weighted_centroid", "pareto_share"}
    for name, path in written.items():
        got = sorted(map(tuple, spark.read.parquet(path).collect()))
        want = sorted(map(tuple, R.run(name, spark, SF_SMALL, fixture="B2").collect()))
        assert got == want, name


def test_cli_writes_selected_marts(spark, hand_path, tmp_path, capsys):
    from cumulus.plans.pipeline import main
    out = tmp_path / "cli"
    main(["--tsv", hand_path, "--out", str(out), "--names", "daily_totals,peak_increment", "--parallelism", "2"])
    printed = capsys.readouterr().out.split()
    assert "daily_totals" in printed and "peak_increment" in printed
    assert sorted(p.name for p in out.iterdir()) == ["daily_totals", "peak_increment"]
