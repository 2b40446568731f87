"""Calendar frames of any lengths from prefix moments (W9-W11 at several lengths at once).

The sum over days d-a to d-b of a group is P(d-b) - P(d-a-1), with P(t) the sums
over all rows up to day t.  Every row therefore asks for P at a few days before
its own.  Rows and questions are merged in one order (a day's row before the questions for it):
one running sum over the merge answers all of them, so any number of frames
costs one sort, each row a few look-ups, and no frame is summed anew.  The answers go back to
their rows by an aggregate on the group and day, which needs no further exchange.
Counts, sums and sums of squares are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.constants import RT_FLOOR
from cumulus.functions.scalar import day_string, ratio
from cumulus.operators.stages import increments
from cumulus.operators.stats import zscore_from_moments

_EXACT = "decimal(38,0)"
Frame = tuple[int, int]  # (a, b): days d-a to d-b, a >= b >= 0


def frame_moments(rows: DataFrame, value: str, frames: Mapping[str, Frame], group: str = "state",
                  time: str = "date") -> DataFrame:
    """(group, time, value) plus, per frame, ``name_n``, ``name_s``, ``name_q``: count, sum and sum of squares of the
    values on the frame's days (0 where there are none).  One row per group and day goes in; null values count as absent."""
    back = sorted({days for a, b in frames.values() for days in (a + 1, b)})
    asked = [F.struct(F.col(time).alias("at"), F.lit(False).alias("asks"), F.lit(None).cast("int").alias("back"))]
    asked += [F.struct(F.date_sub(time, days).alias("at"), F.lit(True).alias("asks"), F.lit(days).alias("back"))
              for days in back]
    merged = rows.select(group, time, value, F.explode(F.array(*asked)).alias("e")).select(group, time, value, "e.*")
    upto = Window.partitionBy(group).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.when(~F.col("asks"), F.col(value))
    square = x.cast("decimal(19,0)") * x.cast("decimal(19,0)")
    sums = merged.select(
        group, time, value, "back", F.count(x).over(upto).alias("_n"), F.coalesce(F.sum(x).over(upto), F.lit(0)).alias("_s"),
        F.coalesce(F.sum(square.cast(_EXACT)).over(upto), F.lit(0)).cast(_EXACT).alias("_q"))
    answers = sums.groupBy(group, time).agg(F.max(value).alias(value), *[
        F.max(F.when(F.col("back") == days, F.col(f"_{m}"))).alias(f"_{m}{days}") for days in back for m in "nsq"])
    return answers.select(group, time, value, *[
        (F.col(f"_{m}{b}") - F.col(f"_{m}{a + 1}")).alias(f"{name}_{m}") for name, (a, b) in frames.items() for m in "nsq"])


def zscore_frames(sd: DataFrame, days: Iterable[int] = (7, 14, 28)) -> DataFrame:
    """(date, state, case_inc, z_7, z_14, ...): z-score of each surviving increment against the days before it,
    as R18 with ``calendar=True`` at every length."""
    days = tuple(days)
    moments = frame_moments(increments(sd).select("date", "state", "case_inc"), "case_inc",
                            {f"_f{k}": (k, 1) for k in days})
    return moments.select("date", "state", "case_inc",
                          *[zscore_from_moments("case_inc", f"_f{k}").alias(f"z_{k}") for k in days])


def reproduction_frames(sd: DataFrame, days: Iterable[int] = (7, 14, 28), floor: int = RT_FLOOR) -> DataFrame:
    """(state, date, days, Rt): the sum of the last k days over that of the k days before them, 2 dp, where the
    earlier sum exceeds ``floor``, as R22 with ``calendar=True`` at every length k."""
    days = tuple(days)
    frames = {f"_this{k}": (k - 1, 0) for k in days} | {f"_last{k}": (2 * k - 1, k) for k in days}
    moments = frame_moments(increments(sd).select("date", "state", "case_inc"), "case_inc", frames)
    rates = F.array(*[F.struct(F.lit(k).alias("days"), F.when(F.col(f"_last{k}_s") > floor, F.round(
        ratio(f"_this{k}_s", f"_last{k}_s"), 2)).alias("Rt")) for k in days])
    return moments.select("state", day_string("date").alias("date"), F.inline(rates)).where("Rt IS NOT NULL")
