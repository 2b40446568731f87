"""Sequential thinning of a trajectory and its segments.

A point is kept when it lies more than ``min_step`` (Euclidean, in degrees)
from the *last kept* point; the first point is always kept.  The rule depends
on the previous decision, so it is a fold, not a window function.  The fold
runs JVM-side with the higher-order ``aggregate`` over each track's points
sorted by time -- one group per track.  A track is a per-day series (one row
per calendar day after the centroid aggregation), so a group holds at most one
point per day of the calendar, independent of the data volume behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.constants import MIN_STEP_DEGREES


#: Points thinned at once; a track of n points copies arrays of n / BLOCK_POINTS blocks.
BLOCK_POINTS = 64


def _valid(c: str) -> Column:
    # Null and 0.0 coordinates are not positions (the chart skipped them as falsy).
    return F.col(c).isNotNull() & (F.col(c) != 0)


def thinned_tracks(points: DataFrame, time: str = "date", x: str = "center_lon", y: str = "center_lat",
                   min_step: float = MIN_STEP_DEGREES, keys: Sequence[str] = ()) -> DataFrame:
    """-> one row per track key with ``kept``: array<struct<time, y, x>> in time order.

    Points are thinned in blocks of ``BLOCK_POINTS``: a block's fold starts from the
    last kept point before it, and its kept points are appended once per block, so
    an array is copied once per block and not once per kept point.
    """
    pts = points.filter(_valid(x) & _valid(y))
    elem = F.struct(F.col(time).alias("t"), F.col(y).cast("double").alias("y"),
                    F.col(x).cast("double").alias("x"))
    elem_type = T.StructType([
        T.StructField("t", pts.schema[time].dataType, True),
        T.StructField("y", T.DoubleType(), True),
        T.StructField("x", T.DoubleType(), True),
    ])
    grouped = pts.groupBy(*keys).agg(F.array_sort(F.collect_list(elem)).alias("_pts"))
    none = F.array().cast(T.ArrayType(elem_type))

    def step(acc, p):
        dy, dx = p["y"] - acc["y"], p["x"] - acc["x"]
        far = acc["y"].isNull() | (F.sqrt(dx * dx + dy * dy) > F.lit(min_step))
        return F.when(far, F.struct(p["y"].alias("y"), p["x"].alias("x"),
                                    F.concat(acc["kept"], F.array(p)).alias("kept"))).otherwise(acc)

    def block_step(acc, b):
        block = F.slice("_pts", b * BLOCK_POINTS + 1, BLOCK_POINTS)
        start = F.struct(acc["y"].alias("y"), acc["x"].alias("x"), none.alias("kept"))
        done = F.aggregate(block, start, step)
        return F.struct(done["y"].alias("y"), done["x"].alias("x"),
                        F.concat(acc["blocks"], F.array(done["kept"])).alias("blocks"))

    blocks = F.sequence(F.lit(0), F.ceil(F.size("_pts") / BLOCK_POINTS).cast("int") - 1)
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("x"),
                     F.array().cast(T.ArrayType(T.ArrayType(elem_type))).alias("blocks"))
    kept = F.flatten(F.aggregate(blocks, start, block_step, lambda acc: acc["blocks"]))
    return grouped.select(*keys, F.when(F.size("_pts") > 0, kept).otherwise(none).alias("kept"))


def _thin_pandas(points: DataFrame, time: str, x: str, y: str, min_step: float,
                 keys: Sequence[str]) -> DataFrame:
    """The same fold per track in a pandas task: linear in the track length."""
    import numpy as np

    pts = points.filter(_valid(x) & _valid(y)).select(*keys, time, F.col(y).cast("double").alias(y),
                                                       F.col(x).cast("double").alias(x))
    schema = T.StructType([pts.schema[k] for k in keys] + [T.StructField("seq", T.IntegerType(), False)]
                          + [pts.schema[time], pts.schema[y], pts.schema[x]])

    def fold(pdf):
        pdf = pdf.sort_values(time, kind="stable").reset_index(drop=True)
        xs, ys = pdf[x].to_numpy(), pdf[y].to_numpy()
        keep = np.zeros(len(pdf), dtype=bool)
        lx = ly = None
        for i in range(len(pdf)):
            if lx is None or np.sqrt((xs[i] - lx) * (xs[i] - lx) + (ys[i] - ly) * (ys[i] - ly)) > min_step:
                keep[i], lx, ly = True, xs[i], ys[i]
        out = pdf[keep].reset_index(drop=True)
        out.insert(len(keys), "seq", np.arange(len(out), dtype="int32"))
        return out[[f.name for f in schema.fields]]

    if keys:
        return pts.groupBy(*keys).applyInPandas(fold, schema)
    # A single track: group on a constant; the track is one row per day.
    return (pts.withColumn("_track", F.lit(0)).groupBy("_track")
            .applyInPandas(lambda pdf: fold(pdf.drop(columns="_track")), schema))


def thin_trajectory(points: DataFrame, time: str = "date", x: str = "center_lon", y: str = "center_lat",
                    min_step: float = MIN_STEP_DEGREES, keys: Sequence[str] = (), method: str = "fold") -> DataFrame:
    """The kept points, one row each: (keys..., seq, time, y, x).

    ``method="fold"`` (default) runs JVM-side in blocks of points.
    ``method="pandas"`` runs the same rule in one pandas task per track.
    """
    if method == "pandas":
        return _thin_pandas(points, time, x, y, min_step, keys)
    tracks = thinned_tracks(points, time, x, y, min_step, keys)
    return (tracks.select(*keys, F.posexplode("kept").alias("seq", "p"))
            .select(*keys, "seq", F.col("p.t").alias(time), F.col("p.y").alias(y), F.col("p.x").alias(x)))


def trajectory_segments(points: DataFrame, time: str = "date", x: str = "center_lon", y: str = "center_lat",
                        min_step: float = MIN_STEP_DEGREES, keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive kept points as (from -> to) segments."""
    tracks = thinned_tracks(points, time, x, y, min_step, keys)
    pairs = F.transform(F.sequence(F.lit(1), F.size("kept") - 1),
                        lambda i: F.struct(F.element_at("kept", i).alias("a"), F.element_at("kept", i + 1).alias("b")))
    return (tracks.filter(F.size("kept") >= 2)
            .select(*keys, F.explode(pairs).alias("s"))
            .select(*keys, F.col("s.a.t").alias(f"from_{time}"), F.col("s.b.t").alias(f"to_{time}"),
                    F.col("s.a.y").alias(f"from_{y}"), F.col("s.a.x").alias(f"from_{x}"),
                    F.col("s.b.y").alias(f"to_{y}"), F.col("s.b.x").alias(f"to_{x}")))
