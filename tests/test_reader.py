import datetime as dt

import pytest


def test_reads_both_date_spellings(spark, hand_path):
    from cumulus.sources.observations import read_obs
    df = read_obs(spark, hand_path)
    assert df.columns == ["date", "county", "state", "cases", "deaths"]
    days = sorted({r.date for r in df.select("date").collect()})
    assert days[0] == dt.date(2020, 3, 1) and days[1] == dt.date(2020, 3, 2)
    assert dt.date(2020, 3, 9) not in days and len(days) == 9
    assert df.count() == 36
    assert dict(df.dtypes)["cases"] == "bigint"


def test_failfast_rejects_bad_rows(spark, bad_path):
    from cumulus.sources.observations import read_obs
    with pytest.raises(Exception):
        read_obs(spark, bad_path).collect()


def test_permissive_rejects_bad_rows(spark, bad_path):
    from cumulus.sources.observations import read_obs, read_rejects
    rows = read_obs(spark, bad_path, mode="PERMISSIVE").collect()
    assert len(rows) == 1 and None not in rows[0]
    bad = read_rejects(spark, bad_path).collect()
    assert len(bad) == 2 and all(r.raw_line for r in bad)
    assert sum(r.date is None for r in bad) == 1           # bad date
    assert sum(r.cases is None for r in bad) == 1          # bad integer


@pytest.mark.parametrize("day", ["2020", "2020-03", "2020-03-03T99", "2020-03-03 junk", "notadate", "2020-13-01", ""])
def test_only_whole_days_are_days(spark, tmp_path, day):
    from cumulus.operators.stages import group_day
    from cumulus.sources.observations import read_obs, read_rejects
    p = tmp_path / "days.tsv"
    p.write_text(f"{day}\tKings\tNew York\t999\t0\n2020-03-02\tKings\tNew York\t12\t0\n")
    with pytest.raises(Exception):
        read_obs(spark, str(p)).collect()
    sd = group_day(read_obs(spark, str(p), mode="PERMISSIVE")).collect()
    assert [(str(r.date), r.total_cases) for r in sd] == [("2020-03-02", 12)]
    assert [r.raw_line for r in read_rejects(spark, str(p)).collect()] == [f"{day}\tKings\tNew York\t999\t0"]


def test_counts_are_long(spark, tmp_path):
    from cumulus.sources.observations import read_obs
    p = tmp_path / "long.tsv"
    p.write_text("2020-03-01\tKings\tNew York\t3000000000\t0\n")
    assert read_obs(spark, str(p)).first().cases == 3_000_000_000


def test_json_sink_keeps_nulls(spark, tmp_path):
    from cumulus.sources.results import read_result, write_result
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "state string, z_score double")
    out = str(tmp_path / "res")
    write_result(df, out, single_file=True, sort_by=["state"])
    text = "".join(p.read_text() for p in (tmp_path / "res").glob("part-*"))
    assert '"z_score":null' in text
    back = read_result(spark, out, "state string, z_score double").orderBy("state").collect()
    assert back[0].z_score is None and back[1].z_score == 1.5


def test_missing_field_is_a_bad_record(spark, tmp_path):
    from cumulus.sources.observations import read_obs
    p = tmp_path / "short.tsv"
    p.write_text("2020-03-01\tKings\tNew York\t10\t0\n2020-03-02\tKings\tNew York\t12\n")
    with pytest.raises(Exception):
        read_obs(spark, str(p)).collect()
    rows = read_obs(spark, str(p), mode="PERMISSIVE").orderBy("date").collect()
    assert [r.deaths for r in rows] == [0]
