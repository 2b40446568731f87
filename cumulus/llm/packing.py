"""Operator 3: packing token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows and a rest.  A
piece's place then depends on its length alone, so best-fit decreasing is done on
the table of piece lengths (at most ``window`` rows, whatever the corpus):
lengths are taken from long to short, and a segment tree indexed by remaining
capacity finds the tightest open windows.  Equal pieces go into equal windows a
run at a time.  The resulting plan says which ranks of a length go to which run
of sequences; pieces get their rank in two steps (counts by slice, then a number
within a slice), so a length that a third of all pieces share is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm import bpe
from cumulus.llm.staging import staged

WINDOW = 1024


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the tightest that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += windows
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` that an open window has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over piece counts by length.

    Returns rows (length, first_rank, first_sequence, offset): the pieces of a
    length from ``first_rank`` on, up to the next row of that length, go one each
    to the sequences from ``first_sequence`` on, at ``offset``.
    """
    tree = CapacityTree(window)
    runs: dict[int, list[tuple[int, int]]] = {}     # remaining capacity -> runs of sequences [a, b)
    plan: list[tuple[int, int, int, int]] = []
    sequences = 0
    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                windows = max(1, left // (window // length))
                runs.setdefault(window, []).append((sequences, sequences + windows))
                tree.add(window, windows)
                sequences += windows
                capacity = window
            # A window stays the tightest until it is full, so it takes its fill at once.
            a, b = runs[capacity].pop()
            pieces = min(left, capacity // length)
            take = min(left // pieces, b - a)
            if take < b - a:
                runs[capacity].append((a + take, b))
            tree.add(capacity, -take)
            for k in range(pieces):
                plan.append((length, rank, a, window - capacity + k * length))
                rank += take
            rest = capacity - pieces * length
            runs.setdefault(rest, []).append((a, a + take))
            tree.add(rest, take)
            left -= take * pieces
    return plan


def pieces_of(docs: DataFrame, id_col: str, ids: str, window: int = WINDOW) -> DataFrame:
    """Cut packed token ids into full windows and a rest: one row per piece with its crc32.

    Returns (id_col, start, length, ids_crc32, doc_tokens).  A document without ids gives no piece.
    """
    n = (F.length(ids) / 4).cast("long")
    cut = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1, F.lit(window).cast("long")),
        lambda s: F.struct(
            s.alias("start"), F.least(F.lit(window).cast("long"), n - s).alias("length"),
            F.crc32(F.substring(F.col(ids), (s * 4 + 1).cast("int"),
                                (F.least(F.lit(window).cast("long"), n - s) * 4).cast("int"))).alias("ids_crc32")))
    cut = F.when(n > 0, cut)
    return (docs.select(F.col(id_col), n.alias("doc_tokens"), F.explode(cut).alias("piece"))
            .select(id_col, "piece.start", "piece.length", "piece.ids_crc32", "doc_tokens"))


def place(pieces: DataFrame, window: int = WINDOW, slices: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Give every piece (any columns, with ``length`` of 1 to ``window``) its sequence and offset.

    Adds sequence_id, offset (gapless from 0 within a sequence) and padded_length
    (the window, or the sequence's own length where that is a power of two).
    Pieces that are equal in ``order`` may change places among each other.
    """
    spark = pieces.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order or [c for c in pieces.columns if c != "length"]
    sliced = staged(pieces.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices))), "pieces")
    by_slice = sliced.groupBy("length", "__slice").agg(F.count(F.lit(1)).alias("n"))
    # At most `window` rows reach the driver.
    counts = {r["length"]: r["n"] for r in by_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(n < 1 or n > window for n in counts):
        raise ValueError(f"piece lengths must be from 1 to {window}")
    plan = plan_windows(counts, window)
    base = by_slice.withColumn("__base", F.sum("n").over(
        Window.partitionBy("length").orderBy("__slice")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "__slice").orderBy(*order)) - 1
    ranked = (sliced.withColumn("__within", within).join(base, ["length", "__slice"])
              .withColumn("__rank", F.col("__base") + F.col("__within")).drop("__slice", "__within", "__base"))
    plan.sort()
    span = 1 << 44
    keys = np.array([length * span + rank for length, rank, _, _ in plan], dtype=np.int64)
    firsts = np.array([a for _, _, a, _ in plan], dtype=np.int64)
    offsets = np.array([o for _, _, _, o in plan], dtype=np.int64)
    ends = _sequence_ends(plan, counts)
    out_schema = ranked.drop("__rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn(
        "offset", F.lit(0).cast("long")).withColumn("padded_length", F.lit(0).cast("long")).schema

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            key = frame["length"].to_numpy() * span + frame["__rank"].to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            frame["sequence_id"] = firsts[at] + key - keys[at]
            frame["offset"] = offsets[at]
            filled = ends[1][np.searchsorted(ends[0], frame["sequence_id"].to_numpy(), side="right") - 1]
            frame["padded_length"] = np.where(filled & (filled - 1) == 0, filled, window)
            yield frame.drop(columns="__rank")

    return ranked.mapInPandas(assign, out_schema)


def _sequence_ends(plan: list[tuple[int, int, int, int]], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Filled length of runs of sequences: (first sequence of each run, its filled length)."""
    after = {}
    for (length, rank, a, offset), following in zip(plan, [*plan[1:], None]):
        end = following[1] if following and following[0] == length else counts[length]
        after[(a, a + end - rank, offset)] = offset + length
    cuts = sorted({x for a, b, _ in after for x in (a, b)})
    if not cuts:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    starts = np.array(cuts, dtype=np.int64)
    filled = np.zeros(len(cuts), dtype=np.int64)
    for (a, b, _), total in after.items():
        i, j = np.searchsorted(starts, [a, b])
        filled[i:j] = np.maximum(filled[i:j], total)
    return starts, filled


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = 0, specials: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents; each one's ids end with ``end_id``.

    A null or empty text is packed as ``end_id`` alone.  Repeated rows are packed
    once each.  Extra columns of any name are left aside; an empty table gives an
    empty result.  Returns (id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_length), all but the id as long.
    """
    encoded = bpe.encode(docs, ranks_path, text=text, ids="__ids", specials=specials, keep=[id_col])
    ended = encoded.withColumn("__ids", F.concat("__ids", F.lit(bytearray(int(end_id).to_bytes(4, "little")))))
    return place(pieces_of(ended, id_col, "__ids", window), window)
