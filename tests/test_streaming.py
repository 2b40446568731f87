from conftest import HAND_TSV


def test_incremental_group_day_equals_batch(spark, tmp_path, hand_sd):
    from cumulus.streaming import group_day_from_partials, start_group_day_ingest
    src = tmp_path / "in"
    src.mkdir()
    lines = HAND_TSV.splitlines()
    # First drop: the early days; second drop: the rest, including a late row for an early day.
    early = [x for x in lines if x.startswith(("2020/3/1", "2020-3-2", "2020-03-03")) and "Beta" not in x]
    rest = [x for x in lines if x not in early]
    (src / "part1.tsv").write_text("\n".join(early) + "\n")
    q = start_group_day_ingest(spark, str(src), str(tmp_path / "partials"), str(tmp_path / "ckpt"),
                               available_now=True)
    q.awaitTermination(120)
    (src / "part2.tsv").write_text("\n".join(rest) + "\n")
    q = start_group_day_ingest(spark, str(src), str(tmp_path / "partials"), str(tmp_path / "ckpt"),
                               available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in group_day_from_partials(spark, str(tmp_path / "partials")).collect())
    want = sorted(tuple(r) for r in hand_sd.collect())
    assert got == want


def test_bad_rows_fail_the_stream_as_they_fail_the_batch(spark, tmp_path):
    import pytest
    from cumulus.streaming import group_day_from_partials, start_group_day_ingest
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("2020-03-01\tKings\tNew York\tten\t0\n2020-03-01\tKings\tNew York\t7\t0\n")
    q = start_group_day_ingest(spark, str(src), str(tmp_path / "p"), str(tmp_path / "c"), available_now=True)
    with pytest.raises(Exception):
        q.awaitTermination(120)
    q = start_group_day_ingest(spark, str(src), str(tmp_path / "p2"), str(tmp_path / "c2"), available_now=True,
                               mode="PERMISSIVE")
    q.awaitTermination(120)
    assert [r.total_cases for r in group_day_from_partials(spark, str(tmp_path / "p2")).collect()] == [7]
