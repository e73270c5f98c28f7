"""Connected components of a link table, by alternating star contractions.

Each round replaces the links by links to smaller neighbours: first every
node's larger neighbours are attached to its smallest one, then its smaller
ones.  Components are kept, paths shorten, and the rounds end with one star
per component whose centre is its smallest node.  Every step is a grouped
minimum (partial aggregation collapses a hub in each map task) and an equi-join
(AQE splits a hub's partition); nothing is gathered on the driver but the
round's link count and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    sym = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    up = sym.filter("v > u").join(low, "u")
    return up.select(F.col("v").alias("u"), F.col("low").alias("v"))  # repeats go in the next step


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` holds u > v only."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    down = links.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return down.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link: ``root`` is the smallest node reachable.

    ``a`` and ``b`` are columns of an ordered type.  Links of a node to itself
    and links with a null end are ignored; repeated links count once.  No
    links: an empty result.
    """
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = staged(links.distinct(), "links")
    state = _state(links)
    while state[0]:
        links = staged(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    star = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
