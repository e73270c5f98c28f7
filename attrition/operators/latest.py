"""Latest row per key, as an aggregate rather than a window.

``latest_per_key(df, keys, order)`` keeps, for each key, the row with the
greatest ``(order..., rest of the row...)`` tuple, NULL ranking lowest — i.e.
``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY o1 DESC NULLS LAST, …,
<remaining columns> DESC NULLS LAST) = 1``.  Ordering by the whole row makes
the choice total, so ties on ``order`` are resolved the same way on every run
and every partitioning (reusing the result twice is safe).

Written as ``max(struct(...))`` per group it is an ordinary aggregate: Spark
runs a partial aggregate before the shuffle, so a key holding a large share of
the rows is reduced to one row per map task instead of being shipped to, and
sorted by, a single reducer as a window partition would be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranked = order + rest
    top = F.max(F.struct(*[F.col(c) for c in ranked])).alias("_top")
    return (
        df.groupBy(*keys)
        .agg(top)
        .select(*[F.col(k) for k in keys], *[F.col(f"_top.{c}").alias(c) for c in ranked])
        .select(*df.columns)
    )
