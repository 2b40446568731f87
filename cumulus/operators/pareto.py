"""Running share of a measure in descending order (Pareto curve), distributed.

Semantics: for a row with value v, ``cum_sum`` = sum of every value >= v, so
rows with equal values share one running total (the RANGE frame of an ordered
window); NULL values come last and add nothing.  Peers are collapsed to one row
per distinct value before the ordered scan (``operators.ordered``), so a value
that most rows share is one row there; the share goes back to the rows by a
join on the value, whose right side is unique (AQE may split a value that most rows share).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.scalar import ratio
from cumulus.operators.ordered import running_sums


def running_share_desc(df: DataFrame, value: str, slices: int | None = None,
                       digits: int | None = 4, out: str = "cum_percent") -> DataFrame:
    mass = df.groupBy(F.col(value).alias("_value")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_mass"))
    cum = running_sums(mass, [F.col("_value").desc_nulls_last()], {"_cum": F.col("_mass")}, slices)
    share = ratio("_cum", "_cum_total")
    if digits is not None:
        share = F.round(share, digits)
    cum = cum.select("_value", share.alias(out))
    return df.join(cum, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")
