"""k-means over whole numbers: deterministic seeds, exact sums, the same labels in any layout.

Every coordinate is a count over its sample standard deviation, as a whole
number of millionths (``grid_points``), so sums, distances and comparisons are
exact integers and no result depends on the order of rows.

Seeds come from one farthest-first traversal of 2k points: it starts at the
point nearest to the mean, and each next one is the farthest from all before
(ties by name).  Each k consecutive points of it start a run of Lloyd rounds; all
runs go on side by side, one aggregate over the points a round, until no cost
falls.  The centres with the lowest cost of all win.  Only centres, counts
and sums reach the driver: at most k rows a run and round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 1_000_000      # steps of a standard deviation
_WIDE = "decimal(19,0)"
_EXACT = "decimal(38,0)"

Centre = tuple[int, ...]


class Run(NamedTuple):
    """A start's centres and the cost of those before them (none yet: infinite)."""
    centres: list[Centre]
    cost: float


def whole_value(column: str, kind: str, log_scale: bool = False) -> Column:
    """A feature as a whole number: counts as they are, others (and logarithms) in billionths."""
    if log_scale:
        return F.round(F.log1p(column) * 1e9).cast("bigint")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("bigint")
    return F.round(F.col(column).cast("double") * 1e9).cast("bigint")


def deviations(points: DataFrame, columns: Sequence[str]) -> list[float]:
    """Sample standard deviations of whole-number columns, from exact moments (0 for fewer than two rows)."""
    moments = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.col(c).cast(_WIDE)
        moments += [F.sum(x.cast(_EXACT)).alias(f"s{i}"), F.sum((x * x).cast(_EXACT)).alias(f"q{i}")]
    row = points.agg(*moments).first()
    n = row["n"]
    return [math.sqrt(float(n * int(row[f"q{i}"]) - int(row[f"s{i}"]) ** 2) / (n * (n - 1))) if n > 1 else 0.0
            for i in range(len(columns))]


def on_grid(column: Column, deviation: float) -> Column:
    """A whole number over its deviation, in steps of the grid (0 where nothing deviates)."""
    if not deviation:
        return F.lit(0).cast("bigint")
    return F.floor(column.cast("double") * float(GRID) / F.lit(deviation) + 0.5).cast("bigint")


def _literal(centre: Centre) -> str:
    return f"array({', '.join(f'{v}L' for v in centre)})"


def centres_literal(centres: Sequence[Centre]) -> str:
    """SQL of the centres as one array.  Constants of this kind are data of the plan, so the code
    that Spark generates for a round serves all rounds."""
    return f"array({', '.join(map(_literal, centres))})"


def _distance(centre: str) -> str:
    """SQL: exact squared distance from ``z`` to a centre."""
    gap = f"CAST(a - b AS {_WIDE})"
    return (f"aggregate(zip_with(z, {centre}, (a, b) -> CAST({gap} * {gap} AS {_EXACT})), CAST(0 AS {_EXACT}), "
            f"(s, x) -> CAST(s + x AS {_EXACT}))")


def nearest(centres: str) -> str:
    """SQL: struct (d, k) of the least distance from ``z`` to the centres and the first centre that has it."""
    return f"array_min(transform({centres}, (c, k) -> struct({_distance('c')} AS d, k)))"


def mean_of(sums: Sequence[int], n: int) -> Centre:
    """The point of the grid nearest to the mean, halves upwards."""
    return tuple((2 * int(s) + n) // (2 * n) for s in sums)


def traversal(points: DataFrame, name: str, axes: int, length: int) -> list[Centre]:
    """Up to ``length`` different points, each the farthest from all before; ties by name."""
    row = points.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(axes)]).first()
    if not row["n"]:
        return []
    middle = mean_of([row[f"s{i}"] for i in range(axes)], row["n"])
    first = points.selectExpr(f"struct({nearest(centres_literal([middle]))}.d AS d, {name}, z) AS p").agg(F.min("p")).first()[0]
    found = [tuple(first["z"])]
    while len(found) < length:
        p = points.selectExpr(f"struct(-{nearest(centres_literal(found))}.d AS d, {name}, z) AS p").agg(F.min("p")).first()[0]
        if not p["d"]:
            break  # every point is one of them
        found.append(tuple(p["z"]))
    return found


def _rounds(points: DataFrame, axes: int, runs: dict[int, Run]) -> dict[int, tuple[int, list[Centre]]]:
    """Of every run: the cost of its centres, and the means of the points nearest to each."""
    starts = ", ".join(f"struct({r} AS run, {centres_literal(run.centres)} AS c)" for r, run in runs.items())
    labelled = points.selectExpr("z", f"inline(array({starts}))").selectExpr("z", "run", f"{nearest('c')} AS near")
    rows = labelled.groupBy("run", F.col("near.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("near.d").alias("cost"),
        *[F.sum(F.col("z")[i].cast(_EXACT)).alias(f"s{i}") for i in range(axes)]).collect()
    out = {r: (0, list(run.centres)) for r, run in runs.items()}  # a centre without points stays
    for row in rows:
        cost, centres = out[row["run"]]
        centres[row["k"]] = mean_of([row[f"s{i}"] for i in range(axes)], row["n"])
        out[row["run"]] = (cost + int(row["cost"]), centres)
    return out


def best_centres(points: DataFrame, name: str, axes: int, k: int) -> list[Centre]:
    """The centres of the lowest cost for ``points`` (name, z: array of ``axes`` whole numbers), by size, then axis
    by axis; fewer than k if there are fewer different points."""
    seeds = traversal(points, name, axes, 2 * k)
    starts = [seeds[i:i + k] for i in range(max(1, len(seeds) - k + 1))] if seeds else []
    runs = {i: Run(s, math.inf) for i, s in enumerate(starts)}
    best: tuple | None = None
    step = 0
    while runs:
        made = _rounds(points, axes, runs)
        for r, (cost, _) in made.items():
            if best is None or (cost, r, step) < best[:3]:
                best = (cost, r, step, runs[r].centres)
        runs = {r: Run(centres, cost) for r, (cost, centres) in made.items() if cost < runs[r].cost}
        step += 1
    return sorted(best[3], key=lambda c: (sum(v * v for v in c), c)) if best else []
