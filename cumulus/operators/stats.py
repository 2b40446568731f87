"""Correlation and trailing z-scores from exact integer moments.

Counts are integers, so n, sum(x), sum(x*x), sum(x*y) are computed exactly
(DECIMAL(38,0) for the squares) and the centred quantities
n*sum(xy) - sum(x)*sum(y) carry no cancellation error.  Only the final ratio is
done in DOUBLE, which also makes the result independent of row order and
partitioning (Welford-style streaming moments are not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from cumulus.operators.ordered import shifted

_EXACT = "decimal(38,0)"


def _dbl(c: Column) -> Column:
    return c.cast("double")


def pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson r over rows where both x and y are non-null; NULL if undefined."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xe = F.when(both, F.col(x).cast(_EXACT))
    ye = F.when(both, F.col(y).cast(_EXACT))
    n = F.count(xe).cast(_EXACT)
    sx, sy = F.sum(xe), F.sum(ye)
    num = n * F.sum(xe * ye) - sx * sy
    dx = n * F.sum(xe * xe) - sx * sx
    dy = n * F.sum(ye * ye) - sy * sy
    return F.try_divide(_dbl(num), F.sqrt(_dbl(dx) * _dbl(dy)))


def trailing_moments(x: str, frame: WindowSpec, prefix: str = "_m") -> list[Column]:
    """Exact window moments of x over ``frame``: count, sum, sum of squares (DECIMAL(38,0))."""
    sq = F.col(x).cast(_EXACT) * F.col(x).cast(_EXACT)
    return [F.count(x).over(frame).alias(f"{prefix}_n"), F.sum(x).over(frame).alias(f"{prefix}_s"),
            F.sum(sq).over(frame).alias(f"{prefix}_q")]


def zscore_from_moments(x: str, prefix: str = "_m") -> Column:
    """(x - mean) / sample-stddev from the moment columns of :func:`trailing_moments`.

    NULL when fewer than two values were in the frame or the deviation is 0.
    """
    n, s, q = F.col(f"{prefix}_n"), F.col(f"{prefix}_s"), F.col(f"{prefix}_q")
    mean = F.try_divide(_dbl(s), _dbl(n))
    var = F.try_divide(_dbl(n.cast(_EXACT) * q - s.cast(_EXACT) * s.cast(_EXACT)), _dbl(n * (n - 1)))
    return F.try_divide(_dbl(F.col(x)) - mean, F.sqrt(var))


def trailing_zscore(df: DataFrame, x: str, frame: WindowSpec, out: str = "z_score") -> DataFrame:
    """df + ``out``: z-score of x against ``frame`` (e.g. the 14 rows before the current one).

    The three window moments are computed once, then combined in a projection.
    """
    with_m = df.select("*", *trailing_moments(x, frame))
    return with_m.withColumn(out, zscore_from_moments(x)).drop("_m_n", "_m_s", "_m_q")


def lead_pairs(national: DataFrame, x: str, y: str, rows: int, time: str = "date") -> DataFrame:
    """Pair x at row t with y at row t + ``rows`` in time order (an ordered scan over range partitions)."""
    return shifted(national, [F.col(time)], rows, {f"{y}_lagged": y}).select(x, f"{y}_lagged")
