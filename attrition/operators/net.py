"""Net lost lines: ended lines without those of renewed keys (line level, for the detail).

Three scans of the contracts: the closed lines, the open ones (for the line that
a cancelled client started last), and the keys' month masks, which give the
renewed months of a ``(client_id, product)`` as bits.  Only keys with a renewal
reach the join; AQE broadcasts them when they are few, and else splits a hot
key's lines.  It is an outer join on a unique key with a filter: an anti join
would be pushed into both branches of the union, and its other side with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.dates import Window
from attrition.operators.active import BLOCK, month_index
from attrition.operators.ended import ended_contracts, line_rule
from attrition.operators.key_masks import blocks, has, renewed_months


def net_lost(contracts: DataFrame, clients: DataFrame, window: Window, base_plan_only: bool = False) -> DataFrame:
    """Ended lines of keys that were not renewed in the month (NULL keys never are)."""
    ended = ended_contracts(contracts, clients, window, base_plan_only)
    keys = renewed_months(contracts, clients, window, line_rule(base_plan_only))
    keys = keys.withColumnRenamed("client_id", "renewed_client").withColumnRenamed("product", "renewed_product")
    same = (F.col("client_id") == F.col("renewed_client")) & (F.col("product") == F.col("renewed_product"))
    slot = month_index(F.col("month"), window.lo)
    months = [slot.between(b * BLOCK, (b + 1) * BLOCK - 1) & has(F.col(f"renewed_{b}"), slot - b * BLOCK) for b in blocks(window)]
    again = F.coalesce(reduce(Column.__or__, months), F.lit(False))
    return ended.join(keys, same, "left").filter(~again).select(*ended.columns)
