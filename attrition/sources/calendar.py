"""Month calendar of a trailing window (a source with no input table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.functions.dates import Window


def month_calendar(spark: SparkSession, window: Window) -> DataFrame:
    """First days of the window's months, ``lo`` … ``month0`` inclusive (16 rows for 15 months)."""
    return spark.range(1).select(
        F.explode(
            F.sequence(F.lit(window.lo), F.lit(window.month0), F.expr("interval 1 month"))
        ).alias("month")
    )
