"""Operator 12: hard negatives by angular triangle filtering.

Vectors become whole numbers, so that scores are exact integers.  Each one
stores its norm and its angles to a few reference directions.  By the triangle
inequality on the sphere the angle between two vectors lies between the
difference and the sum of their angles to any direction; the cosines of these
ends, times the norms and widened for rounding, bound the score.  An anchor
looks for scores in windows: for positives from its best so far upwards, for
negatives between a share of a positive's score and that score.  Only rows whose
bounds overlap a window are scored.

Rows, and apart from them anchors, are numbered in the order of label, nearest
direction and angle to it, and cut into stripes of a fixed size.  A pair of
stripes is one task group; pairs whose stripes cannot reach a window are left
out before any row is sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.staging import numbered, staged

SCALE = 256
DIRECTIONS = 8        # reference directions
SAMPLE = 2048         # rows that the directions are chosen from; any choice gives the same results
ROWS = 8192           # rows of a stripe
ANCHORS = 1024        # anchors of a stripe
AT_ONCE = (64, 2048)  # anchors and rows whose bounds are held at once
SLACK = 1e-6          # of a bound, for the rounding of angles and cosines
EXACT = 2.0 ** 53     # products below it are exact in double precision
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _whole_numbers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, label, is_anchor, dim, whole, norm) of the rows that take part."""
        for batch in batches:
            kept, dims, wholes, norms = [], [], [], []
            for k, (i, label, vector) in enumerate(zip(batch.column(0), batch.column(1), batch.column(3))):
                if not (i.is_valid and label.is_valid and vector.is_valid) or vector.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(whole).all():
                    continue
                top = np.abs(whole).max(initial=0)
                kept.append(k)
                dims.append(len(whole))
                wholes.append(whole.tobytes())
                norms.append(float(top * np.sqrt(((whole / top) ** 2).sum())) if top else 0.0)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(dims, pa.int32()), pa.array(wholes, pa.binary()),
                 pa.array(norms, pa.float64())], names=["id", "label", "is_anchor", "dim", "whole", "norm"])
    return run


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0)
    if not top:
        return x
    x = x / top
    return x / np.sqrt((x * x).sum())


def directions(sample: list[np.ndarray], count: int) -> dict[int, np.ndarray]:
    """Per number of dimensions, ``count`` unit vectors of the sample, each the farthest from those before."""
    found = {}
    for dim in {len(x) for x in sample if x.any()}:
        units = np.array([_unit(x) for x in sample if len(x) == dim and x.any()])
        chosen = [units[0]]
        nearest = units @ units[0]
        while len(chosen) < count:
            k = int(nearest.argmin())
            chosen.append(units[k])
            nearest = np.maximum(nearest, units @ units[k])
        found[dim] = np.array(chosen)
    return found


def _angles(known: dict[int, np.ndarray], count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the angles to the directions, the nearest direction and the angle to it."""
        for batch in batches:
            angles, homes, leads = [], [], []
            for dim, whole in zip(batch.column("dim").to_pylist(), batch.column("whole").to_pylist()):
                # Lengths outside of the sample are measured against the first axis.
                axes = known.get(dim, np.eye(1, dim).repeat(count, axis=0))
                angle = np.arccos(np.clip(axes @ _unit(np.frombuffer(whole)), -1, 1))
                home = int(angle.argmin())
                angles.append(angle.tolist())
                homes.append(home)
                leads.append(float(angle[home]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(angles, pa.list_(pa.float64())), pa.array(homes, pa.int32()),
                 pa.array(leads, pa.float64())], names=[*batch.schema.names, "angles", "home", "lead"])
    return run


def score_bounds(norms: tuple[np.ndarray, np.ndarray],
                 angles: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs of two sets of rows, safe for rounding."""
    apart = np.zeros((len(angles[0]), len(angles[1])))
    together = np.full_like(apart, math.pi)
    for k in range(angles[0].shape[1]):
        x, y = angles[0][:, k, None], angles[1][None, :, k]
        np.maximum(apart, np.abs(x - y), out=apart)
        np.minimum(together, x + y, out=together)
    size = norms[0][:, None] * norms[1][None, :]
    room = SLACK * size + 1
    return size * np.cos(together) - room, size * np.cos(apart) + room


def _scores(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows r of x with the rows c of y."""
    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(y).max(initial=0) < EXACT:
        if 8 * len(r) > len(x) * len(y):
            return (x @ y.T)[r, c].astype(np.int64)
        return np.einsum("ij,ij->i", x[r], y[c]).astype(np.int64)
    # Too large for doubles: Python's integers.  A score that no long holds is an OverflowError.
    left, right = ([[int(v) for v in row] for row in m] for m in (x, y))
    return np.array([sum(a * b for a, b in zip(left[i], right[j])) for i, j in zip(r, c)], dtype=np.int64)


def windows_best(anchors: dict, rows: dict, same: bool, count: int) -> list[tuple[int, int, int, int]]:
    """(anchor key, window's upper end, id, score) of the first ``count`` rows in each window of each anchor.

    ``anchors`` and ``rows`` hold equally long vectors as arrays: key, id, label
    (as numbers), whole, norm, angles, and windows (lists of lower and upper
    ends) for anchors.  ``same``: rows of the anchor's label with another id,
    else those of other labels.
    """
    best = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in w] for w in anchors["windows"]]
    lows = [[low for low, _ in w] for w in anchors["windows"]]
    top = np.array([max((high for _, high in w), default=LOWEST) for w in anchors["windows"]], dtype=np.float64)
    for k in range(0, len(rows["id"]), AT_ONCE[1]):
        some = slice(k, k + AT_ONCE[1])
        for g in range(0, len(anchors["id"]), AT_ONCE[0]):
            few = slice(g, g + AT_ONCE[0])
            reach = np.array([min(w, default=math.inf) for w in lows[few]], dtype=np.float64)
            equal = anchors["label"][few][:, None] == rows["label"][some][None, :]
            fit = equal & (anchors["id"][few][:, None] != rows["id"][some][None, :]) if same else ~equal
            low, high = score_bounds((anchors["norm"][few], rows["norm"][some]),
                                     (anchors["angles"][few], rows["angles"][some]))
            r, c = np.nonzero(fit & (high >= reach[:, None]) & (low <= top[few][:, None]))
            if not len(r):
                continue
            scores = _scores(anchors["whole"][few], rows["whole"][some], r, c)
            ends = np.searchsorted(r, np.arange(r[-1] + 2))
            for a in np.unique(r):
                mine, ids = scores[ends[a]:ends[a + 1]], rows["id"][some][c[ends[a]:ends[a + 1]]]
                for w, (_, upper) in enumerate(anchors["windows"][g + a]):
                    good = (mine >= lows[g + a][w]) & (mine <= upper)
                    if not good.any():
                        continue
                    s = np.concatenate([best[g + a][w][0], mine[good]])
                    i = np.concatenate([best[g + a][w][1], ids[good]])
                    order = np.lexsort((i, -s))[:count]
                    best[g + a][w] = (s[order], i[order])
                    if len(order) == count:
                        lows[g + a][w] = int(s[order[-1]])
    return [(int(anchors["key"][a]), upper, int(i), int(s))
            for a, w in enumerate(anchors["windows"])
            for (_, upper), (found, ids) in zip(w, best[a]) for s, i in zip(found, ids)]


def _arrays(table: pa.Table, dim: int, codes: dict) -> dict:
    part = table.filter(pa.compute.equal(table.column("dim"), dim))
    return {"id": part.column("id").to_numpy(), "norm": part.column("norm").to_numpy(),
            "label": np.array([codes[x] for x in part.column("label").to_pylist()], dtype=np.int64),
            "whole": np.frombuffer(b"".join(part.column("whole").to_pylist())).reshape(len(part), dim),
            "angles": np.array(part.column("angles").to_pylist(), dtype=np.float64).reshape(len(part), -1)} | (
        {"key": part.column("key").to_numpy(),
         "windows": [[(w["low"], w["high"]) for w in row] for row in part.column("windows").to_pylist()]}
        if "key" in part.column_names else {})


def _search_pair(same: bool, count: int):
    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(anchors) and len(rows):
            labels = {*anchors.column("label").to_pylist(), *rows.column("label").to_pylist()}
            codes = {label: k for k, label in enumerate(labels)}
            for dim in {*anchors.column("dim").to_pylist()} & {*rows.column("dim").to_pylist()}:
                found += windows_best(_arrays(anchors, dim, codes), _arrays(rows, dim, codes), same, count)
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in range(4)],
                        names=["key", "high", "id", "score"])
    return run


def _ends(rows: DataFrame, stripe: str, mark: str, *more: Column) -> DataFrame:
    """What the rows of each stripe have in common: ranges of label, length, norm and angles."""
    angle = [F.struct(F.min(F.col("angles")[k]).alias("lo"), F.max(F.col("angles")[k]).alias("hi"))
             for k in range(DIRECTIONS)]
    return rows.groupBy(stripe).agg(
        *[f(c).alias(f"{mark}_{c}_{end}") for c in ("label", "dim", "norm") for end, f in (("lo", F.min), ("hi", F.max))],
        F.array(*angle).alias(f"{mark}_angles"), *more)


def _pairs(anchors: DataFrame, rows: DataFrame, stripes: int, same: bool) -> DataFrame:
    """(i, j, near) of the stripes of anchors and rows whose bounds overlap the anchors' windows.

    Row stripes meet every stripe of anchors by its number: a stated set of
    anchors against all rows.  Stripes of several lengths of vectors are not judged by angles.
    """
    a = _ends(anchors, "i", "a", F.min("at").alias("from"), F.max("at").alias("to"),
              F.min(F.array_min("windows.low")).alias("low"), F.max(F.array_max("windows.high")).alias("high"))
    b = _ends(rows, "j", "b", F.min("idx").alias("first"), F.max("idx").alias("last"))
    both = b.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))).join(a, "i")
    pairs = both.where("a_dim_lo <= b_dim_hi AND b_dim_lo <= a_dim_hi")
    if same:
        pairs = pairs.where("a_label_lo <= b_label_hi AND b_label_lo <= a_label_hi")
    else:
        pairs = pairs.where("NOT (a_label_lo = a_label_hi AND b_label_lo = b_label_hi AND a_label_lo = b_label_lo)")
    ends = F.zip_with("a_angles", "b_angles", lambda x, y: F.struct(
        F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)).alias("apart"),
        F.least(x["hi"] + y["hi"], F.lit(math.pi)).alias("together")))
    upper, lower = F.cos(F.array_max(ends["apart"])), F.cos(F.array_min(ends["together"]))
    large, small = F.col("a_norm_hi") * F.col("b_norm_hi"), F.col("a_norm_lo") * F.col("b_norm_lo")
    room = large * SLACK + 1
    one = F.expr("a_dim_lo = a_dim_hi AND b_dim_lo = b_dim_hi")
    pairs = pairs.where(~one | ((upper * F.when(upper >= 0, large).otherwise(small) + room >= F.col("low"))
                                & (lower * F.when(lower >= 0, small).otherwise(large) - room <= F.col("high"))))
    return pairs.select("i", "j", F.expr("from <= last AND first <= to").alias("near"))


def _search(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, same: bool, count: int) -> DataFrame:
    columns = ["id", "label", "dim", "whole", "norm", "angles"]
    left = anchors.join(pairs, "i").select("i", "j", "key", "windows", *columns).groupBy("i", "j")
    right = rows.join(pairs, "j").select("i", "j", *columns).groupBy("i", "j")
    return left.cogroup(right).applyInArrow(_search_pair(same, count), "key long, high long, id long, score long")


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5),
         id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         scale: int = SCALE) -> DataFrame:
    """The hard negatives of every anchor and each of its positives.

    A component x counts as floor(scale * x); a score is the integer inner
    product.  Higher scores come first, ties by the smaller id.  An anchor's
    positives are its first ``positives`` rows of the same label and another id;
    a positive's negatives are the first ``negatives`` rows of other labels whose
    score s has share * positive_score <= s <= positive_score, ``share`` being a
    fraction (so none for a positive of a negative score).  Returns (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or with a component that is null or,
    times ``scale``, not finite, take no part.  An empty vector scores 0, as a
    zero one does.  Vectors of different lengths are not compared.  Rows that
    repeat an id are rows of their own, but none is another's positive.  A score
    that no long holds raises.  Other columns play no part; an empty table, and one
    without anchors, gives an empty table.
    """
    label = F.col(label) if isinstance(label, str) else label
    every = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                           F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
                           F.col(vector).cast("array<double>").alias("vector"))
    whole = staged(every.mapInArrow(_whole_numbers(scale), "id long, label string, is_anchor boolean, dim int, "
                                                           "whole binary, norm double"), "whole_vectors")
    sample = whole.orderBy(F.xxhash64("id", "whole"), "id").limit(SAMPLE).select("whole").collect()
    known = directions([np.frombuffer(r["whole"]) for r in sample], DIRECTIONS)
    measured = whole.mapInArrow(_angles(known, DIRECTIONS), whole.schema.simpleString()[7:-1].replace(":", " ")
                                + ", angles array<double>, home int, lead double")
    order = ["dim", "label", "home", "lead", "id"]
    rows = numbered(measured.withColumn("tree", F.lit("")), order, "rows")
    rows = staged(rows.withColumn("j", F.expr(f"idx div {ROWS}")).drop("tree", "n"), "stripes")

    wanted = rows.where("is_anchor").select(F.lit("").alias("tree"), F.col("idx").alias("at"), "id", "label", "dim",
                                            "whole", "norm", "angles")
    wanted = numbered(wanted.withColumnRenamed("at", "place"), ["place"], "anchors")
    wanted = staged(wanted.select(F.col("idx").alias("key"), F.expr(f"idx div {ANCHORS}").alias("i"),
                                  F.col("place").alias("at"), "id", "label", "dim", "whole", "norm", "angles"), "anchors")
    stripes = wanted.agg(F.max("i")).first()[0]
    stripes = 0 if stripes is None else stripes + 1

    def windows(low: Column, high: Column) -> Column:
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    # Positives: the stripes around the anchors first, whose best scores are the windows elsewhere.
    open_ended = wanted.withColumn("windows", F.array(windows(F.lit(LOWEST), F.lit(HIGHEST))))
    if stripes:
        near = staged(_pairs(open_ended, rows, stripes, True), "near_pairs")
        found = staged(_search(open_ended, rows, near.where("near"), True, positives), "near_positives")
        reached = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), False).alias("s"))
        reached = reached.where(F.col("n") >= positives).select("key", F.col("s")[positives - 1].alias("low"))
        closer = wanted.join(reached, "key", "left").withColumn("windows", F.array(windows(
            F.coalesce("low", F.lit(LOWEST)), F.lit(HIGHEST)))).drop("low")
        far = staged(_pairs(closer, rows, stripes, True).where("NOT near"), "far_pairs")
        found = found.unionByName(_search(closer, rows, far, True, positives))
    else:
        found = open_ended.select("key", F.lit(HIGHEST).alias("high"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    chosen = staged(_first(found, ["key"], positives).select(
        "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives: one window per positive score of an anchor.  ceil(share * p) without an overflow for p >= 0:
    top, of = share
    least = F.expr(f"(positive_score div {of}) * {top} + CAST(ceil((positive_score % {of}) * {top} / {of}) AS BIGINT)")
    asked = chosen.where("positive_score >= 0").groupBy("key").agg(
        F.collect_set(windows(least, F.col("positive_score"))).alias("windows"))
    asked = wanted.join(asked, "key")
    if stripes:
        pairs = staged(_pairs(asked, rows, stripes, False), "pairs")
        found = _search(asked, rows, pairs, False, negatives)
    else:
        found = found.limit(0)
    found = _first(found, ["key", "high"], negatives)
    out = chosen.join(found, (chosen["key"] == found["key"]) & (chosen["positive_score"] == found["high"])).drop(
        found["key"]).join(wanted.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))
