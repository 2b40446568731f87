import datetime as dt
import random

import pytest

from cumulus.operators import marts as M
from cumulus.operators.stages import group_day, with_increments
from cumulus.sources.observations import OBS_SCHEMA, read_obs
from cumulus.streaming.increments import IncrementTable, start_increments

START = dt.date(2021, 1, 1)


def observations(seed):
    draw = random.Random(seed)
    rows = []
    for state in ("A", "B", "C", "D"):
        for unit in ("x", "y"):
            cases = 0
            for day in range(30):
                if draw.random() < 0.2:
                    continue
                cases = max(0, cases + draw.choice([0, 3, 10, 25, -4]))
                rows.append((START + dt.timedelta(days=day), unit, state, cases, cases // 9))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.select("date", "state", "total_cases", "total_deaths", "case_inc", "death_inc").collect()))


@pytest.mark.parametrize("seed,compact_every", [(1, 100), (2, 2)])
def test_batches_in_any_order_equal_the_whole(spark, tmp_path, seed, compact_every):
    rows = observations(seed)
    draw = random.Random(seed)
    # Mostly by time, but a fifth of the rows comes in a later batch, and the last batch is all late.
    batches = [[] for _ in range(6)]
    for r in rows:
        k = (r[0] - START).days // 7
        batches[draw.randrange(k, 6) if draw.random() < 0.2 else k].append(r)
    table = IncrementTable(spark, str(tmp_path / "t"), compact_every)
    assert table.current().count() == 0
    seen = []
    for n, batch in enumerate(batches):
        seen += batch
        table.apply(spark.createDataFrame(batch, OBS_SCHEMA), n)
        want = with_increments(group_day(spark.createDataFrame(seen, OBS_SCHEMA)))
        assert rows_of(table.current()) == rows_of(want)
    assert len(table._complete("segments")) < len(batches) or compact_every == 100
    assert (len(table._complete("base")) > 0) == (compact_every == 2)
    # A batch that runs again, from the state before it, leaves the same table.
    table.apply(spark.createDataFrame(batches[-1], OBS_SCHEMA), len(batches) - 1)
    assert rows_of(table.current()) == rows_of(want)
    assert sorted(map(tuple, M.daily_increase(table.current()).collect())) == sorted(map(tuple, M.daily_increase(want).collect()))


def test_new_days_read_no_history(spark, tmp_path, monkeypatch):
    table = IncrementTable(spark, str(tmp_path / "t"))
    day = lambda k, n: [(START + dt.timedelta(days=k), "x", s, n, 0) for s in ("A", "B")]
    table.apply(spark.createDataFrame(day(0, 5), OBS_SCHEMA), 0)
    asked = []
    plain = IncrementTable.current
    monkeypatch.setattr(IncrementTable, "current", lambda self, before=None, **kw: asked.append(before) or plain(self, before, **kw))
    table.apply(spark.createDataFrame(day(3, 9), OBS_SCHEMA), 1)
    assert asked == []
    table.apply(spark.createDataFrame(day(1, 7), OBS_SCHEMA), 2)
    assert asked == [2]
    monkeypatch.undo()
    got = {(r.date.day, r.state): r.case_inc for r in table.current().collect()}
    assert got == {(1, s): 5 for s in "AB"} | {(2, s): 2 for s in "AB"} | {(4, s): 2 for s in "AB"}


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    table = IncrementTable(spark, str(tmp_path / "t"))
    table.apply(spark.createDataFrame([(START, "x", "A", 5, 1)], OBS_SCHEMA), 0)
    before = rows_of(table.current())
    # The segment of batch 1 is written, its heads are not: the state is that of batch 0.
    table.current().write.parquet(table._path("segments", 1))
    assert rows_of(table.current()) == before
    table.apply(spark.createDataFrame([(START, "y", "A", 2, 0)], OBS_SCHEMA), 1)
    assert rows_of(table.current()) == [(START, "A", 7, 1, 7, 1)]


def test_stream_of_files_with_late_ones(spark, tmp_path, hand_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = open(hand_path).read().splitlines()
    random.Random(4).shuffle(lines)
    table = IncrementTable(spark, str(tmp_path / "table"), compact_every=2)
    for k in range(3):
        (src / f"part{k}.tsv").write_text("\n".join(lines[k::3]) + "\n")
        start_increments(spark, str(src), table, str(tmp_path / "ckpt"), available_now=True).awaitTermination(120)
    want = with_increments(group_day(read_obs(spark, hand_path)))
    assert rows_of(table.current()) == rows_of(want)
    got, whole = (sorted(map(tuple, M.rolling_mean_7(sd).collect())) for sd in (table.current(), want))
    assert got == whole


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    table = IncrementTable(spark, str(tmp_path / "t"))
    table.apply(spark.createDataFrame([(START, "x", "A", 5, 1)], OBS_SCHEMA), 0)
    table.apply(spark.createDataFrame([], OBS_SCHEMA), 1)
    assert rows_of(table.current()) == [(START, "A", 5, 1, 5, 1)]
