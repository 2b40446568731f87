"""Column expressions shared by the marts (all JVM-side built-ins)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


DAY_PATTERN = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"


def try_parse_day(c: str | Column) -> Column:
    """``2020/1/21``, ``2020-1-21`` and ``2020-01-21`` -> DATE; anything else becomes NULL."""
    return F.when(_col(c).rlike(DAY_PATTERN), F.try_to_date(F.regexp_replace(_col(c), "/", "-")))


def parse_day(c: str | Column) -> Column:
    """Like :func:`try_parse_day`, but a malformed day fails the job."""
    day = try_parse_day(c)
    return F.when(_col(c).isNotNull() & day.isNull(), F.raise_error(F.lit("malformed day")).cast("date")).otherwise(day)


def day_string(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def month_key(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def pct(c: str | Column, digits: int = 2) -> Column:
    return F.round(_col(c) * F.lit(100), digits)


def doubling_days(r: str | Column, digits: int = 2) -> Column:
    """ln 2 / ln(1 + r) for a positive relative growth r, else NULL."""
    r = _col(r)
    return F.when(r > 0, F.round(F.try_divide(F.lit(LN2), F.log1p(r)), digits))


def bin_index(c: str | Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin holding ``c``: (-inf,e0] -> 0, (e0,e1] -> 1, ...

    Bins are contiguous, so every value lands in exactly one of len(edges)+1 bins.
    """
    c = _col(c)
    expr = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        expr = F.when(c <= F.lit(edges[i]), F.lit(i)).otherwise(expr)
    return F.when(c.isNotNull(), expr)
