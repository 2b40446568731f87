"""Running sums, row numbers, leads and lags over one global order, without a window in one task.

Rows are range-partitioned by the order; a window inside each slice gives local
sums.  The first row of a slice then tells every slice its slice's totals (at
most ``MAX_SLICES`` squared small rows), and what the earlier slices hold is
added to the local sums.  All of it is one lineage: a slice is known by the
partition that its rows are in, which is read off once, so results do not
depend on whether Spark plans, samples or reuses an exchange once or twice.

Leads and lags number the rows this way and cut them into blocks of a fixed
number of rows; the rows at a block's edge are sent to its neighbour as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SLICES = 512
BLOCK = 4096  # rows of a block, or as many as a shift has, whichever is more


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column],
                 slices: int | None = None) -> DataFrame:
    """``df`` plus, for each entry (name, value) of ``sums``: ``name``, the sum of the values up to and with the row in
    ``order``, and ``name_total``, that of all rows.  Null values add nothing (sums over none are 0).

    ``order`` decides alone, so it should leave no ties: rows that tie follow each other in any order.
    """
    p = min(MAX_SLICES, max(1, slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = df.repartitionByRange(p, *order).withColumn("_slice", F.spark_partition_id())
    inside = Window.partitionBy("_slice")
    sorted_ = inside.orderBy(*order)
    upto = sorted_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*", (F.row_number().over(sorted_) == 1).alias("_head"),
        *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"_run_{n}") for n, v in sums.items()],
        *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_mass_{n}") for n, v in sums.items()])
    told = F.when(F.col("_head"), F.sequence(F.lit(0), F.lit(p - 1))).otherwise(F.array("_slice"))
    sent = local.withColumn("_to", F.explode(told))
    here = Window.partitionBy("_to")
    earlier = F.col("_head") & (F.col("_slice") < F.col("_to"))
    out = sent.select(
        *df.columns, "_slice", "_to",
        *[(F.col(f"_run_{n}") + F.coalesce(F.sum(F.when(earlier, F.col(f"_mass_{n}"))).over(here), F.lit(0))).alias(n)
          for n in sums],
        *[F.sum(F.when(F.col("_head"), F.col(f"_mass_{n}"))).over(here).alias(f"{n}_total") for n in sums])
    return out.where("_to = _slice").drop("_to", "_slice")


def shifted(df: DataFrame, order: Sequence[Column], rows: int, columns: Mapping[str, str],
            slices: int | None = None) -> DataFrame:
    """``df`` plus, for each entry (name, column): the column's value ``rows`` rows later in ``order`` (earlier, if
    negative); null where there is no such row."""
    if not rows:
        return df.select("*", *[F.col(c).alias(n) for n, c in columns.items()])
    size, reach = max(BLOCK, abs(rows)), abs(rows)
    numbered = running_sums(df, order, {"_row": F.lit(1)}, slices).drop("_row_total").withColumn("_at", F.col("_row") - 1)
    block, place = F.floor(F.col("_at") / size), F.col("_at") % size
    edge = place < reach if rows > 0 else place >= size - reach
    neighbour = block - 1 if rows > 0 else block + 1
    sent = numbered.withColumn("_own", block).withColumn("_block", F.explode(
        F.when(edge, F.array(block, neighbour)).otherwise(F.array(block))))
    inside = Window.partitionBy("_block").orderBy("_at")
    step = F.lead if rows > 0 else F.lag
    out = sent.select(*df.columns, "_own", "_block", *[step(c, reach).over(inside).alias(n) for n, c in columns.items()])
    return out.where("_own = _block").drop("_own", "_block")
