"""Top-N / bottom-N and top-k per group with deterministic tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(by: str, ascending: bool, tiebreak: Sequence[str]):
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return [key] + [F.col(t).asc() for t in tiebreak]


def top_n(df: DataFrame, by: str, n: int, ascending: bool = False,
          tiebreak: Sequence[str] = ("state",)) -> DataFrame:
    """The n rows with the largest (or smallest) ``by``; planned as TakeOrderedAndProject."""
    return df.orderBy(*_order(by, ascending, tiebreak)).limit(n)


def top_per_group(df: DataFrame, partition: Sequence[str] | str, by: str, n: int,
                  ascending: bool = False, tiebreak: Sequence[str] = ("state",),
                  rank_col: str | None = None) -> DataFrame:
    """At most n rows per partition key; ``row_number() <= n`` becomes a WindowGroupLimit."""
    parts = [partition] if isinstance(partition, str) else list(partition)
    w = Window.partitionBy(*parts).orderBy(*_order(by, ascending, tiebreak))
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)
