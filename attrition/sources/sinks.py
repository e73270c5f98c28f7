"""Sinks: a dataset as Parquet, as a whole or month by month.

The datasets are small by construction except the detail; partitioning by
``month`` lets a reader of one period prune the rest, and a run replace its own
months alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, partition_by: str | None = "month", mode: str = "overwrite") -> str:
    """``df`` at ``path``, in place of what was there."""
    writer = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def write_months(df: DataFrame, path: str, months: Iterable[date]) -> str:
    """``df`` at ``path`` in place of the given months; other months stay as they are.

    Rows of further months are not written.  A month without rows is taken off
    the table: dynamic overwrite replaces the folders of the months it writes,
    and which those are is observed on the way (no second pass).
    """
    months = sorted(set(months))
    own = df.filter(F.col("month").isin(months)) if months else df.limit(0)
    seen = Observation("months")
    observed = own.observe(seen, F.collect_set(F.col("month").cast("string")).alias("written"))
    observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    written = set(seen.get["written"])
    for month in months:
        if month.isoformat() not in written:
            _remove(df.sparkSession, f"{path}/month={month.isoformat()}")
    return path


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store Spark has it in; nothing if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
