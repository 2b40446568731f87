"""Incremental ingest of new observation files into the group-day stage.

Observation files keep arriving (a new day, a late county).  The only heavy
stage, the sum to (date, group), is maintained with Structured Streaming:

* a file-stream source reads new tab-separated files with the fixed schema;
* each micro-batch is pre-aggregated to partial sums per (date, group) and
  written under ``partials/batch_id=N`` with mode overwrite, so a re-run of the
  same batch after a failure replaces its own output (exactly-once with the
  stream checkpoint);
* nothing is dropped for lateness: a late file only adds a partial row, and
  ``group_day_from_partials`` re-sums all partials when the marts run (the
  partials table is small: one row per (date, group) per batch).

The marts then run on ``group_day_from_partials(...)`` exactly as on
``group_day(obs)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cumulus.operators.stages import group_day
from cumulus.sources.observations import read_obs_stream


def _write_partials(out_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # One row per (date, group) seen in the batch; AQE merges small reduce tasks, so
        # a small batch leaves few files and a first batch of the whole history many.
        group_day(batch).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")
    return write


def start_group_day_ingest(spark: SparkSession, in_dir: str, partials_dir: str, checkpoint: str,
                           available_now: bool = False, every: str | None = None,
                           mode: str = "FAILFAST") -> StreamingQuery:
    """Start the stream; ``checkpoint`` must be a shared folder on a cluster.  ``mode`` as for ``read_obs``."""
    writer = (read_obs_stream(spark, in_dir, mode).writeStream
              .foreachBatch(_write_partials(partials_dir))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def group_day_from_partials(spark: SparkSession, partials_dir: str) -> DataFrame:
    """Re-sum the partials: the same (date, state, total_cases, total_deaths) as ``group_day``."""
    p = spark.read.parquet(partials_dir)
    return (p.groupBy("date", "state")
            .agg(F.sum("total_cases").cast("bigint").alias("total_cases"),
                 F.sum("total_deaths").cast("bigint").alias("total_deaths")))
