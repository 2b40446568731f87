"""Operator 4: near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to their principal axes, so the
leading coordinates hold most of a product.  Equal vectors of a label become one
row with a weight.  Rows of a label are tiled along the first axis; tiles whose
ranges are further apart than two similar vectors can be are never compared.  A
pair of tiles is compared in one task: products of the leading coordinates come
first, the rest is bounded by the norms of the suffixes (Cauchy-Schwarz), and a
pair is given up as soon as its cosine cannot reach the threshold.  A tile pair
returns counts and its local components, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.staging import connected_components, staged

TILE = 2048            # rows of a tile
ROWS_AT_ONCE = 256     # rows of a tile compared at once
STEPS = [8, 16, 32]    # coordinates after which bounds are tested
SLACK = 1e-9           # for rounding in bounds


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, digest, unit) of the vectors that can be compared."""
    for batch in batches:
        ids, labels, dims, digests, units = [], [], [], [], []
        for i, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if i is None or label is None or not vector.is_valid or vector.values.null_count or not len(vector.values):
                continue
            raw = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(raw).all() or not raw.any():
                continue
            raw = raw / np.abs(raw).max()
            unit = raw / np.sqrt(raw @ raw)
            ids.append(i)
            labels.append(label)
            dims.append(len(raw))
            digests.append(hashlib.blake2b(raw.tobytes(), digest_size=16).digest())
            units.append(unit.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()),
             pa.array(digests, pa.binary()), pa.array(units, pa.binary())],
            names=["id", "label", "dim", "digest", "unit"])


def principal_axes(units: DataFrame, dim: int) -> np.ndarray:
    """Columns are the principal axes of the rows of ``units``, by falling variance.

    Tasks emit sums of products, added up by Spark; dim * (dim + 1) / 2 numbers reach the driver.
    """
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float64).reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])],
                                         names=["i", "j", "s"])

    rows = units.select("unit").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(
        F.sum("s").alias("s")).collect()
    matrix = np.zeros((dim, dim))
    for r in rows:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["s"]
    values, vectors = np.linalg.eigh(matrix)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


def links_between(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (r, c) of all pairs of unit rows whose cosine reaches the threshold."""
    dim = x.shape[1]
    cuts = [*[s for s in STEPS if s < dim], dim]
    rest = [[np.sqrt((m[:, c:] ** 2).sum(axis=1)) for c in cuts] for m in (x, y)]
    rows, columns = [], []
    for k in range(0, len(x), ROWS_AT_ONCE):
        part = x[k:k + ROWS_AT_ONCE]
        product = part[:, :cuts[0]] @ y[:, :cuts[0]].T
        bound = product + rest[0][0][k:k + ROWS_AT_ONCE, None] * rest[1][0][None, :]
        r, c = np.nonzero(bound >= threshold - SLACK)
        so_far = product[r, c]
        for step, (a, b) in enumerate(zip(cuts, cuts[1:]), start=1):
            if not len(r):
                break
            so_far = so_far + np.einsum("ij,ij->i", part[r, a:b], y[c, a:b])
            good = so_far + rest[0][step][k + r] * rest[1][step][c] >= threshold - SLACK
            r, c, so_far = r[good], c[good], so_far[good]
        good = so_far >= threshold
        rows.append(r[good] + k)
        columns.append(c[good])
    return np.concatenate(rows), np.concatenate(columns)


def _roots(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Smallest number reachable over the pairs (r, c), of the numbers below n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[r], root[c])
        new = root.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["ka"] == row["kb"]
                ids, weights, vectors = ([np.frombuffer(row[f"{c}{s}"], dtype=t) for s in ("a", "b")] for c, t in (
                    ("ids", np.int64), ("weights", np.int64), ("vectors", np.float64)))
                x, y = (v.reshape(len(i), -1) for v, i in zip(vectors, ids))
                r, c = links_between(x, y, threshold)
                if same:
                    r, c = r[r != c], c[r != c]
                if not len(r):
                    continue
                # Both tiles' rows side by side, in the order of their ids, so that roots are smallest ids.
                every = np.unique(np.concatenate(ids))
                at = [np.searchsorted(every, i) for i in ids]
                count = np.zeros(len(every), dtype=np.int64)
                np.add.at(count, at[0][r], weights[1][c])
                if not same:
                    np.add.at(count, at[1][c], weights[0][r])
                root = _roots(len(every), at[0][r], at[1][c])
                linked = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[linked]), pa.array(count[linked]), pa.array(every[root[linked]])],
                    names=["rep", "n", "root"])
    return run


def _pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rep")
    return pd.DataFrame({
        "key": ["/".join(map(str, key))], "label": [key[0]], "dim": [key[1]],
        "lo": [frame["lead"].min()], "hi": [frame["lead"].max()],
        "ids": [frame["rep"].to_numpy(np.int64).tobytes()], "weights": [frame["weight"].to_numpy(np.int64).tobytes()],
        "vectors": [b"".join(frame["vector"])]})


def links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector: str = "embedding",
          label: str = "label") -> DataFrame:
    """Links of every vector with the vectors of its label whose cosine is at least ``threshold``.

    Returns (id_col, n_links, component_id, kept), one row per row of ``vectors``:
    how many other rows are linked directly, the smallest id reachable, and
    whether that is its own.  Vectors that are null, empty, zero or hold null or
    non-finite components, and those without label or id, link with nothing
    (0 links, their own component; a null id has a null component and is kept).
    Vectors of different lengths never link.  Rows that repeat an id count as
    vectors of their own and share its component.  Other columns play no part; an
    empty table gives an empty table.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                           F.col(vector).cast("array<double>").alias("vector"))
    units = staged(every.mapInArrow(_units, "id long, label string, dim int, digest binary, unit binary"), "units")
    classes = units.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"),
                                                   F.min(F.struct("id", "dim", "unit")).alias("own"))
    classes = staged(classes.select("label", "digest", "rep", "weight", "own.dim", "own.unit"), "classes")
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    axes = principal_axes(classes.where(F.col("dim") == common["dim"]), common["dim"]) if common else np.eye(1)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned, lead = [], []
            for dim, unit in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                row = np.frombuffer(unit, dtype=np.float64)
                row = row @ axes if dim == len(axes) else row
                turned.append(row.tobytes())
                lead.append(float(row[0]))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [
                pa.array(lead, pa.float64()), pa.array(turned, pa.binary())],
                names=["label", "dim", "rep", "weight", "lead", "vector"])

    turned = staged(classes.select("label", "dim", "rep", "weight", "unit").mapInArrow(
        rotate, "label string, dim int, rep long, weight long, lead double, vector binary"), "turned")

    # Tiles: neighbouring bins of the first axis together, a crowded bin split by a hash.
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    binned = turned.withColumn("bin", F.floor(F.col("lead") * (32 / reach)))
    bins = binned.groupBy("label", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label", "dim").orderBy("bin")) - F.col("n")
    bins = bins.select("label", "dim", "bin", F.floor(before / TILE).alias("tile"),
                       F.ceil(F.col("n") / TILE).alias("parts"))
    bins = bins.withColumn("tile", F.when(F.col("parts") > 1, -1 - F.col("bin") + F.lit(-1 << 20)).otherwise(F.col("tile")))
    tiled = binned.join(bins, ["label", "dim", "bin"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    tiles = staged(tiled.select("label", "dim", "tile", "part", "rep", "weight", "lead", "vector").groupBy(
        "label", "dim", "tile", "part").applyInPandas(
        _pack, "key string, label string, dim int, lo double, hi double, ids binary, weights binary, vectors binary"),
        "tiles")
    ends = tiles.select("key", "label", "dim", "lo", "hi")
    a, b = ends.alias("a"), ends.alias("b")
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & F.expr(
        f"a.key <= b.key AND a.lo <= b.hi + {reach!r} AND b.lo <= a.hi + {reach!r}")
    pairs = a.join(b, near).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))
    # Either tile may come first: by a hash, so that no tile is the first of all its pairs.
    swap = F.pmod(F.xxhash64("x", "y"), F.lit(2)) == 1
    pairs = pairs.select(F.when(swap, F.col("x")).otherwise(F.col("y")).alias("ka"),
                         F.when(swap, F.col("y")).otherwise(F.col("x")).alias("kb"))
    held = ["ids", "weights", "vectors"]
    left = tiles.select(F.col("key").alias("ka"), *[F.col(c).alias(f"{c}a") for c in held])
    right = tiles.select(F.col("key").alias("kb"), *[F.col(c).alias(f"{c}b") for c in held])
    found = staged(pairs.join(left, "ka").join(right, "kb").mapInArrow(
        _compare(threshold), "rep long, n long, root long"), "links")

    counts = found.groupBy("rep").agg(F.sum("n").alias("linked"))
    # An id whose rows hold different vectors joins them; a class joins its own ids.
    joined = units.join(classes.select("label", "digest", "rep", "weight"), ["label", "digest"])
    joined = staged(joined.select("id", "rep", "weight"), "members")
    ids = joined.where("id != rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")).distinct()
    graph = found.where("rep != root").select(F.col("rep").alias("src"), F.col("root").alias("dst")).unionByName(ids)
    labels = connected_components(graph)
    rows = joined.join(counts, "rep", "left").select(
        "id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    alone = _without_unit(every).select("id", F.lit(0).cast("long").alias("n_links"))
    out = rows.unionByName(alone).join(labels, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_links", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _without_unit(every: DataFrame) -> DataFrame:
    """The rows that ``_units`` leaves out."""
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
              & fine & F.exists("vector", lambda v: v != 0))
    return every.where(~F.coalesce(usable, F.lit(False))).select("id")
