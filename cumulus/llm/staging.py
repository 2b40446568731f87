"""Written tables that cut lineage, row numbers, and component labels over a link table.

Everything here is written under the shared folder that ``spark.checkpoint.dir``
names, so any executor can read it back after another one is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cumulus.session import checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cumulus_{label}_{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with its own schema."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._staged_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of tables from ``staged`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def numbered(nodes: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``nodes`` with idx (place in its tree by ``order``) and n (its tree's nodes).

    Rows are range-partitioned by tree and order, so a large tree is spread over
    many tasks; places come from the partitions' counts, of which there is one
    per tree and partition.
    """
    placed = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = staged(placed.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    runs = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("rows").over(whole).alias("n"))
    return placed.withColumn("part", part).join(runs, ["tree", "part"]).withColumn(
        "idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _are_stars(pairs: DataFrame) -> bool:
    """Every u has one v, and no v is a u itself."""
    several = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    passing = pairs.select(F.col("v").alias("u")).join(pairs.select("u"), "u", "left_semi")
    return several.unionByName(passing).isEmpty()


def connected_components(links: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id that occurs in ``links(src, dst)``.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    round is a grouped minimum (combined before the shuffle) and a join back
    that AQE may split, so a hub with a third of all ids is spread over many
    tasks.  Every round is written to the shared folder.  Ends when every id
    hangs on its component's smallest; more than ``max_rounds`` rounds raise an error rather than
    return unfinished labels.  Null ends and loops are ignored.
    Returns (id, component_id).
    """
    pairs = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs = staged(pairs.where("u != v").distinct(), label)
    for _ in range(max_rounds):
        if _are_stars(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u != v").distinct(), label)
        dropped(pairs)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        pairs = staged(small.distinct(), label)
        dropped(large)
    else:
        raise RuntimeError(f"component labels did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
