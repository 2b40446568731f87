"""Dimension tables; joins on them carry no hint, AQE broadcasts what it measures as small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.constants import REFERENCE_COORDS

COORD_SCHEMA = T.StructType([
    T.StructField("state", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
])


def reference_coords(spark: SparkSession) -> DataFrame:
    """The original 12-row coordinate table, for real per-state input."""
    return spark.createDataFrame(REFERENCE_COORDS, COORD_SCHEMA)


def nation_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates for every nation of the test data: lat = 25 + key, lon = -70 - 2 * key."""
    nation = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet")
    key = F.col("n_nationkey")
    return nation.select(F.col("n_name").alias("state"),
                         (F.lit(25) + key).cast("double").alias("lat"),
                         (F.lit(-70) - F.lit(2) * key).cast("double").alias("lon"))
