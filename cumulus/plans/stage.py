"""Materialising a shared stage so later plans read it instead of recomputing it."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from cumulus.operators.stages import group_day, with_increments
from cumulus.session import checkpoint_dir

# Folders that this process has written, per application; removed when it ends.
_WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    if not _WRITTEN:
        atexit.register(_drop_at_exit)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete the stages that this application has written; returns how many folders went."""
    sc, gone = spark.sparkContext, 0
    for path in _WRITTEN.pop(sc.applicationId, []):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True))
    return gone


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_stages(spark)


#: Bytes of source files that a task reads, and of shuffled rows that it takes, while a stage is written.
TASK_BYTES = 8 << 20


@contextmanager
def small_tasks(spark: SparkSession, source_bytes: int) -> Iterator[None]:
    """Plans that run within deal their rows to as many tasks as the size of their source files asks for.

    A task then sorts and sums a fixed number of rows at most, however large the
    tables are.  Otherwise it is cores that bound the number of tasks first, and a
    task's memory grows with the tables.  The session's own smaller sizes hold.
    """
    conf = spark.conf
    smaller = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    partitions = max(int(conf.get("spark.sql.shuffle.partitions")), -(-source_bytes // TASK_BYTES))
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    kept = {k: conf.get(k) for k in smaller} | {first: conf.get(first, None)}
    try:
        for k in smaller:
            size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(kept[k])
            conf.set(k, str(min(size, TASK_BYTES)))
        conf.set(first, str(partitions))
        yield
    finally:
        for k, v in kept.items():
            conf.unset(k) if v is None else conf.set(k, v)


def stage_table(spark: SparkSession, df: DataFrame, label: str = "stage",
                bucket_by: str | None = None, buckets: int | None = None,
                partitioned: bool = False) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    This cuts the lineage: every later plan (scalar subqueries, self-joins,
    several marts) scans the small written table, and a lost executor re-reads
    it rather than re-running the scan of the source tables.

    With ``bucket_by`` the stage is an external table bucketed on that column
    (one file per bucket: rows are hash-partitioned the same way first, unless
    ``partitioned`` says that they are), so windows and aggregations keyed by it
    run without an exchange.  There are as many buckets as shuffle partitions.
    If the catalog refuses the table, a plain Parquet stage is written instead;
    any other failure is raised.  On a cluster without a shared folder, so is
    that (see ``checkpoint_dir``).
    """
    name = f"cumulus_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    if bucket_by:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df if partitioned else df.repartition(n, bucket_by)
        try:
            (rows.write.mode("overwrite").bucketBy(n, bucket_by).sortBy(bucket_by)
             .option("path", path).saveAsTable(name))
            staged = spark.table(name)
            # The resolved relation keeps the files and the bucket layout; the catalog
            # entry of this external table is only needed to read it back, so no table
            # is left behind in a shared catalog.
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            return staged
        except AnalysisException:
            path = new_path(spark, name + "_files")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage_group_days(spark: SparkSession, obs: DataFrame | None = None, sd: DataFrame | None = None,
                     buckets: int | None = None) -> DataFrame:
    """The group-day table with its increments, bucketed by group.

    Rows are hash-partitioned by group into the stage's buckets below the lag
    window, so window and buckets share one exchange at any partition setting.
    """
    sd = group_day(obs) if sd is None else sd
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stage_table(spark, with_increments(sd.repartition(n, "state")), "group-day", bucket_by="state",
                       buckets=n, partitioned=True)
