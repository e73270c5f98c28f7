"""Global order for frames that are small by construction.

The aggregated datasets and report frames have at most 16 months × 7 plans
rows whatever the input size.  ``repartition(1)`` moves only those result rows,
after the last aggregation, so the aggregation itself stays parallel; a
range-partitioned ``orderBy`` would add a sampling job.  Frames whose size grows
with the input (the loss detail) use the distributed ``orderBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def order_bounded(df: DataFrame, *cols: str | Column) -> DataFrame:
    """``df.orderBy(*cols)`` for a frame with a small, fixed upper bound on rows."""
    return df.repartition(1).sortWithinPartitions(*cols)
