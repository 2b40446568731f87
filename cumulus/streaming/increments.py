"""Daily increments kept up to date while observation files arrive, late ones included.

Each micro-batch changes only what it must:

* its rows are summed to group-days (``group_day``), the change of each day's totals;
* the *heads*, one row per group, hold each group's last day.  A batch whose days
  all follow a group's head needs nothing else of that group's past: the head is
  the row before its first new day;
* a batch that changes an earlier day replays that group from its first changed
  day: the days from there on and the one before them are read, re-summed and
  differenced again;
* the replayed rows are one *segment*.  A day's row in the latest segment counts;
  after ``compact_every`` segments all are merged into a *base*.

Segment and heads of batch N are folders named N, written with mode overwrite
from the state before N, so a batch that runs again after a failure replaces its
own output; a batch counts from when its heads are complete.  Nothing is
dropped for lateness.  ``current`` is the group-day table with its increments: all marts run on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cumulus.operators.stages import group_day, with_increments
from cumulus.sources.observations import read_obs_stream

DAYS = "date date, state string, total_cases bigint, total_deaths bigint"
ROWS = DAYS + ", case_inc bigint, death_inc bigint"


class IncrementTable:
    """The folders of one table: deltas, segments, heads and bases, each by batch number."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 8):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def _path(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}/{n}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the folders that have been written to their end."""
        fs, p = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(q.getName()) for q in names if fs.exists(self._fs(f"{q}/_SUCCESS")[1]))

    def _drop(self, kind: str, below: int) -> None:
        for n in self._complete(kind):
            if n < below:
                fs, p = self._fs(self._path(kind, n))
                fs.delete(p, True)

    def _read(self, kind: str, n: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(kind, n))

    def current(self, before: int | None = None, base_below: int | None = None) -> DataFrame:
        """(date, state, totals, increments) after all complete batches (those numbered below ``before``), on the last
        base (numbered below ``base_below``)."""
        done = [n for n in self._complete("heads") if before is None or n < before]
        last = max(done, default=-1)
        base = max((n for n in self._complete("base")
                    if n <= last and (base_below is None or n < base_below)), default=-1)
        parts = [self._read("base", base, ROWS).withColumn("_n", F.lit(base))] if base >= 0 else []
        parts += [self._read("segments", n, ROWS).withColumn("_n", F.lit(n))
                  for n in self._complete("segments") if base < n <= last]
        if not parts:
            return self.spark.createDataFrame([], ROWS)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(parts) == 1:
            return rows.drop("_n")
        latest = rows.groupBy("date", "state").agg(F.max_by(F.struct(
            "total_cases", "total_deaths", "case_inc", "death_inc"), "_n").alias("row"))
        return latest.select("date", "state", "row.*")

    def heads(self, before: int) -> DataFrame:
        done = [n for n in self._complete("heads") if n < before]
        return self._read("heads", max(done), DAYS) if done else self.spark.createDataFrame([], DAYS)

    def apply(self, batch: DataFrame, n: int) -> None:
        """Add the observations of micro-batch ``n``."""
        group_day(batch).write.mode("overwrite").parquet(self._path("deltas", n))
        delta = self._read("deltas", n, DAYS)
        heads = self.heads(n)
        head = heads.select(F.col("state").alias("_group"), F.struct("date", "total_cases", "total_deaths").alias("_head"))
        touched = delta.groupBy("state").agg(F.min("date").alias("_first")).join(
            head, F.col("state").eqNullSafe(F.col("_group")), "left").select(
            F.col("state").alias("_group"), "_first", "_head")
        late = touched.where("_head.date >= _first")
        changed = delta
        before = touched.where("_head.date < _first").select("_head.date", F.col("_group").alias("state"),
                                                             "_head.total_cases", "_head.total_deaths")
        if not late.isEmpty():
            past = self.current(before=n).select("date", "state", "total_cases", "total_deaths")
            past = past.join(late.drop("_head"), past["state"].eqNullSafe(F.col("_group")))
            changed = changed.unionByName(past.where("date >= _first").select(*delta.columns))
            last = past.where("date < _first").groupBy("state").agg(
                F.max_by(F.struct("date", "total_cases", "total_deaths"), "date").alias("row"))
            before = before.unionByName(last.select("row.date", "state", "row.total_cases", "row.total_deaths"))
        changed = changed.groupBy("date", "state").agg(F.sum("total_cases").alias("total_cases"),
                                                       F.sum("total_deaths").alias("total_deaths"))
        rows = with_increments(changed.withColumn("_new", F.lit(True)).unionByName(before.withColumn("_new", F.lit(False))))
        rows.where("_new").drop("_new").write.mode("overwrite").parquet(self._path("segments", n))
        segment = self._read("segments", n, ROWS)
        ahead = segment.groupBy("state").agg(F.max_by(F.struct("date", "total_cases", "total_deaths"), "date").alias("row"))
        ahead = ahead.select("row.date", "state", "row.total_cases", "row.total_deaths")
        kept = heads.join(ahead.select(F.col("state").alias("_group")), F.col("state").eqNullSafe(F.col("_group")), "left_anti")
        kept.unionByName(ahead).write.mode("overwrite").parquet(self._path("heads", n))
        self._drop("heads", n - 1)
        self._drop("deltas", n)
        self._compact(n)

    def _compact(self, n: int) -> None:
        bases = [b for b in self._complete("base") if b < n]
        base = max(bases, default=-1)
        if len([s for s in self._complete("segments") if base < s <= n]) < self.compact_every:
            return
        self.current(before=n + 1, base_below=n).write.mode("overwrite").parquet(self._path("base", n))
        # What the base before this one has merged serves no run of batch n any more.
        self._drop("segments", base + 1)
        self._drop("base", base)


def start_increments(spark: SparkSession, in_dir: str, table: IncrementTable, checkpoint: str,
                     available_now: bool = False, every: str | None = None, mode: str = "FAILFAST",
                     max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Feed new tab-separated observation files of ``in_dir`` into ``table``; ``checkpoint`` and the table's folder
    must be shared ones on a cluster."""
    writer = (read_obs_stream(spark, in_dir, mode, max_files_per_trigger=max_files_per_trigger).writeStream
              .foreachBatch(table.apply).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()
