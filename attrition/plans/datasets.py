"""The four datasets: losses by module, by plan, per line, and the active base.

Output schemas (counts BIGINT, dates DATE, money DOUBLE):

* ``lost_by_module_month``  month, module, lost_clients, lost_amount
* ``lost_by_plan_month``    month, plan, lost_clients, lost_amount
* ``lost_detail``           month, module, plan, client_id, client_name, product, lost_amount
* ``active_by_plan_month``  month, plan, active_clients

Money is summed as DECIMAL and cast to DOUBLE only at the end.  The group
count is bounded by construction (≤16 months × 4 modules or 7 plans), so the
final ORDER BY sorts a handful of rows; the distinct counts are planned by
Spark as partial dedupe on (group, client) → shuffle → count, which collapses
a hot client within each map task before anything is shuffled.  The grouped
datasets read the per-key net amounts (``net_lost_per_key``), the detail the
net lines (``net_lost``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions import rules
from attrition.functions.dates import Window
from attrition.operators.active import active_counts, touches
from attrition.operators.ended import net_lost_per_key
from attrition.operators.net import net_lost
from attrition.plans.ordering import order_bounded


def lost_by(net: DataFrame, name: str, code: Column, exact: bool = False) -> DataFrame:
    """``count(distinct client_id)`` and ``sum(amount)`` per (month, code).

    ``exact`` keeps the DECIMAL sum (for further re-aggregation); otherwise
    the amount is returned as DOUBLE.
    """
    total = F.sum("amount")
    out = net.groupBy("month", code.alias(name)).agg(
        F.count_distinct("client_id").alias("lost_clients"),
        (total if exact else total.cast("double")).alias("lost_amount"),
    )
    return order_bounded(out, "month", name)  # ≤ 16 months × 4 modules / 7 plans


def lost_by_both(net: DataFrame) -> DataFrame:
    """D1 and D2 in one pass: ``month, module, plan, lost_clients, lost_amount`` (exact), one of the codes NULL.

    Rows with a module are ``lost_by(net, "module", …)``, those with a plan the
    same by plan over the base plan lines.  Lines are summed per key first, so
    the grouping sets double only a row per key.  At most 16 × (4 + 7) rows.
    """
    per_key = net.groupBy("client_id", "product", "month").agg(F.sum("amount").alias("amount"))
    coded = per_key.select(
        "month",
        F.lower(rules.module_of("product")).alias("module"),
        F.when(rules.is_base_plan_line("product"), F.lower(rules.plan_of("product"))).alias("plan"),
        "client_id",
        "amount",
    )
    sets = coded.groupingSets([["month", "module"], ["month", "plan"]], "month", "module", "plan")
    out = sets.agg(F.count_distinct("client_id").alias("lost_clients"), F.sum("amount").alias("lost_amount"))
    # Both codes are NULL where a module line has no plan.
    return order_bounded(out.filter("module IS NOT NULL OR plan IS NOT NULL"), "month", "module", "plan")


def lost_by_module_month(
    contracts: DataFrame, clients: DataFrame, window: Window, exact: bool = False
) -> DataFrame:
    net = net_lost_per_key(contracts, clients, window)
    return lost_by(net, "module", F.lower(rules.module_of("product")), exact)


def lost_by_plan_month(
    contracts: DataFrame, clients: DataFrame, window: Window, exact: bool = False
) -> DataFrame:
    # The add-on exclusion depends on the product only, so it commutes with
    # the latest-line rule and the renewal test (both keyed by product):
    # filtering before them is the same as after, and cheaper.
    net = net_lost_per_key(contracts, clients, window, base_plan_only=True)
    return lost_by(net, "plan", F.lower(rules.plan_of("product")), exact)


def lost_detail(
    contracts: DataFrame, clients: DataFrame, window: Window, sort: bool = True
) -> DataFrame:
    """Net lost lines with module/plan labels and the client's name.

    Left join on ``client_id``: a client listed twice in ``clients`` shows
    its lines twice, as the source does.  Sorted by month, then amount, both
    descending with NULLs last (set ``sort=False`` to skip the global sort).
    """
    return with_names(net_lost(contracts, clients, window), clients, sort)


def with_names(net: DataFrame, clients: DataFrame, sort: bool = True) -> DataFrame:
    """Label net lost lines (module, plan, client name) for the detail dataset."""
    names = clients.select("client_id", "client_name")
    out = net.join(names, "client_id", "left").select(
        "month",
        rules.module_display_of("product").alias("module"),
        F.upper(rules.plan_of("product")).alias("plan"),
        "client_id",
        F.coalesce(F.col("client_name"), F.col("client_id")).alias("client_name"),
        "product",
        F.col("amount").cast("double").alias("lost_amount"),
    )
    return sort_detail(out) if sort else out


def sort_detail(detail: DataFrame) -> DataFrame:
    """Month, then amount, both descending with NULLs last (the detail's order).

    Client, product and name only break ties: they fix the order of rows that
    differ and let the range partitioner spread a month with many equal
    amounts.  Exact copies of a row are counted first and numbered, and the
    number comes last: copies land in several partitions instead of one task,
    and since it depends on the rows alone, a task that runs again sends every
    row where it went before.
    """
    columns = detail.columns
    counted = detail.groupBy(*columns).agg(F.count("*").alias("_copies"))
    ordered = numbered_copies(counted, columns).orderBy(
        F.col("month").desc_nulls_last(),
        F.col("lost_amount").desc_nulls_last(),
        F.col("client_id").asc_nulls_last(),
        F.col("product").asc_nulls_last(),
        F.col("client_name").asc_nulls_last(),
        "_copy",
    )
    return ordered.select(*columns)


def numbered_copies(counted: DataFrame, columns: list[str]) -> DataFrame:
    """Each row ``_copies`` times, numbered by ``_copy`` from 0.

    In two levels, blocks and places within a block, of about the square root of
    the number of copies each: no row holds a number for every copy, and between
    the levels the blocks of a row are dealt out, so no task makes them all.
    """
    size = F.ceil(F.sqrt("_copies"))
    last = F.lit(1).cast("long")
    blocks = counted.withColumn("_size", size).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - last) / F.col("_size")))))
    dealt = blocks.repartition(*columns, "_block")
    start = F.col("_block") * F.col("_size")
    return dealt.withColumn("_copy", F.explode(F.sequence(start, F.least(start + F.col("_size"), F.col("_copies")) - last)))


def sort_within_months(detail: DataFrame) -> DataFrame:
    """The detail in order within each task's rows, for files laid out by month."""
    return detail.sortWithinPartitions(F.col("month").asc(), F.col("lost_amount").desc_nulls_last())


def active_by_plan_month(contracts: DataFrame, window: Window) -> DataFrame:
    """Distinct active clients per (month, plan) on the first day of each month.

    Unlike the loss datasets, the base keeps one-off items and ignores client
    cancellation dates (a cancelled client's open line stays active): the
    numerator and denominator of the loss rate are defined differently.
    """
    # The bounds come first: the stored dates they use are not projected.
    base = contracts.filter(touches(contracts, window) & rules.is_base_plan_line("product")).select(
        "client_id", "start_date", "end_date", F.lower(rules.plan_of("product")).alias("plan")
    )
    counts = active_counts(base, window, group="plan", entity="client_id")
    out = counts.select("month", "plan", F.col("active").cast("long").alias("active_clients"))
    return order_bounded(out, "month", "plan")  # ≤ 16 months × 7 plans
