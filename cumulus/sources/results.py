"""Result sinks and readers (JSON lines, Parquet).

Nulls are written out explicitly (``ignoreNullFields=false``) so a NULL z-score
stays a NULL instead of vanishing from the record.  ``single_file=True`` is for
marts of a bounded size only: it funnels the rows through one task, sorted inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def write_result(df: DataFrame, path: str, fmt: str = "json", single_file: bool = False,
                 sort_by: Sequence[str | Column] | None = None, mode: str = "overwrite") -> None:
    if single_file:
        df = df.coalesce(1)
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode)
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def read_result(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                fmt: str = "json") -> DataFrame:
    """Read every part file of a result folder; blank lines are skipped by the JSON reader."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "json":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")
