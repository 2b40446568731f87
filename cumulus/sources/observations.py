"""Reader for the headerless tab-separated file of cumulative counts.

One explicit schema replaces both ingest paths of the original jobs (a Python
``map`` over text lines and CSV type inference): no inference job, no Python
worker, and the scan is splittable.  A row is bad when a field is missing or is
no integer or day.  ``mode="FAILFAST"`` fails the job on the first bad row;
``mode="PERMISSIVE"`` leaves bad rows out, and ``read_rejects`` returns them with
their raw line, so none can reach a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.functions.scalar import try_parse_day

RAW_SCHEMA = T.StructType([
    T.StructField("date_str", T.StringType(), True),
    T.StructField("county", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("cases", T.LongType(), True),
    T.StructField("deaths", T.LongType(), True),
])

OBS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("county", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("cases", T.LongType(), False),
    T.StructField("deaths", T.LongType(), False),
])


def _parsed(raw: DataFrame) -> DataFrame:
    """RAW_SCHEMA (+ the raw line) -> the observation's fields, NULL where malformed."""
    return raw.select(try_parse_day("date_str").alias("date"), "county", "state", "cases", "deaths", "_corrupt_record")


def bad_row() -> Column:
    """A field is missing or malformed."""
    bad = F.col("_corrupt_record").isNotNull()
    for c in OBS_SCHEMA.fieldNames():
        bad = bad | F.col(c).isNull()
    return bad


def _raw_schema() -> T.StructType:
    return T.StructType(RAW_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType(), True)])


def _options(reader, sep: str):
    return (reader.schema(_raw_schema()).option("sep", sep).option("header", "false").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record"))


def checked(raw: DataFrame, mode: str) -> DataFrame:
    """Parsed rows by the reader's mode: bad ones fail the job, or are left out."""
    rows = _parsed(raw)
    if mode.upper() == "FAILFAST":
        day = F.when(bad_row(), F.raise_error(F.lit("malformed observation row")).cast("date")).otherwise(F.col("date"))
        rows = rows.withColumn("date", day)
    else:
        rows = rows.where(~bad_row())
    return rows.select(*OBS_SCHEMA.fieldNames())


def read_obs(spark: SparkSession, path: str, mode: str = "FAILFAST", sep: str = "\t") -> DataFrame:
    """path (file, folder or glob on any Hadoop FS) -> the columns of OBS_SCHEMA, none of them NULL."""
    return checked(_options(spark.read, sep).csv(path), mode)


def read_rejects(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The bad rows of ``path``: what could be parsed of them, and the raw line in ``raw_line``."""
    fields = RAW_SCHEMA.fieldNames()
    line = F.coalesce("_corrupt_record", F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))
    raw = _options(spark.read, sep).csv(path)
    rows = raw.select(try_parse_day("date_str").alias("date"), *fields, "_corrupt_record", line.alias("raw_line"))
    return rows.where(bad_row()).select(*OBS_SCHEMA.fieldNames(), "raw_line")


def read_obs_stream(spark: SparkSession, in_dir: str, mode: str = "FAILFAST", sep: str = "\t",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream, with the batch reader's checks."""
    reader = _options(spark.readStream, sep)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return checked(reader.csv(in_dir), mode)
