"""Everything a (client, product) did in the window's months, in one pass over the contracts.

``key_masks`` reads the contracts once and gives one row per
``(client_id, product)`` with a bit for each month of the window: active on the
month's first day, ended in the month, ended on the month's last day, restarted
in the month after.  Bits are OR-ed, a fixed-width hash aggregate that
pre-aggregates in each map task, so a hot key is one row a task before the
shuffle.  The cancelled clients join after it, on rows that are already
collapsed: of a cancelled client's open lines only that there is one counts, and
of several cancellations the last, as in the latest-line rule.

Renewals are then bit arithmetic, ``month_end & restart``: no second scan and no
join.  The base and the losses by plan (``base_and_lost``) and the renewed
months of the detail (``renewed_months``) are read from it.

The rules depend on the product alone, so they may be applied to the contracts
before or to the masks after.  A mask holds ``BLOCK`` months; a longer window
has further masks in the same row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions import dates, rules
from attrition.functions.dates import Window
from attrition.operators.active import BLOCK, covered_months, month_index, touches
from attrition.operators.ended import cancelled_in, closes, restarts

KINDS = ("active", "ended", "month_end", "restart")


def blocks(window: Window) -> range:
    """Numbers of the masks of a window's ``months`` and the running one."""
    return range(-(-(window.months + 1) // BLOCK))


def _left(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _bit(slot: Column, block: int, when: Column | bool = True) -> Column:
    """Mask of the block with the bit of month number ``slot``; 0 if it is NULL, in another block, or ``when`` fails."""
    at = slot - block * BLOCK
    return F.when(F.lit(when) & at.between(0, BLOCK - 1), _left(at)).otherwise(F.lit(0).cast("long"))


def _bits(first: Column, last: Column, block: int) -> Column:
    """Mask of the block with the bits from ``first`` to ``last``; 0 if there are none."""
    low, high = F.greatest(first - block * BLOCK, F.lit(0)), F.least(last - block * BLOCK, F.lit(BLOCK - 1))
    return F.when((first <= last) & (low <= high), _left(high + 1) - _left(low)).otherwise(F.lit(0).cast("long"))


def has(mask: Column, i: Column) -> Column:
    """Whether bit ``i`` is set."""
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1


def key_masks(contracts: DataFrame, clients: DataFrame, window: Window) -> DataFrame:
    """``client_id, product`` and, for each kind of ``KINDS`` and block of months, a mask such as ``ended_0``."""
    closed, starts, active = closes(contracts, window), restarts(contracts, window), touches(contracts, window)
    is_open = dates.on_days(contracts, lambda day: day("end_date").missing())
    ended_on = dates.effective_end("cancel_date", "end_date")
    lo, hi = covered_months(contracts, window)
    lines = contracts.filter(closed | starts | active | is_open).select(
        "client_id",
        "product",
        F.when(closed, month_index(ended_on, window.lo)).alias("end"),
        (closed & dates.is_month_end(ended_on)).alias("at_month_end"),
        F.when(starts, month_index(F.col("start_date"), window.lo) - 1).alias("restart"),
        F.when(active, month_index(lo, window.lo)).alias("first"),
        F.when(active, month_index(hi, window.lo)).alias("last"),
        is_open.alias("open"),
    )
    masks = {
        "active": lambda b: _bits(F.col("first"), F.col("last"), b),
        "ended": lambda b: _bit(F.col("end"), b),
        "month_end": lambda b: _bit(F.col("end"), b, F.col("at_month_end")),
        "restart": lambda b: _bit(F.col("restart"), b),
    }
    merged = [F.bit_or(masks[kind](b)).alias(f"{kind}_{b}") for kind in KINDS for b in blocks(window)]
    per_key = lines.groupBy("client_id", "product").agg(F.bool_or("open").alias("open"), *merged)
    cancelled = cancelled_in(clients, window).groupBy("client_id").agg(F.max("ended_on").alias("ended_on"))
    slot = F.when(F.col("open"), month_index(F.col("ended_on"), window.lo))
    of_open = {"ended": F.lit(True), "month_end": dates.is_month_end("ended_on")}
    columns = [
        F.col(f"{kind}_{b}").bitwiseOR(_bit(slot, b, of_open[kind])).alias(f"{kind}_{b}") if kind in of_open else F.col(f"{kind}_{b}")
        for kind in KINDS
        for b in blocks(window)
    ]
    return per_key.join(cancelled, "client_id", "left").select("client_id", "product", *columns)


def renewed(block: int) -> Column:
    """Months in which a key is renewed; a key with a NULL part matches no restart."""
    both = F.col(f"month_end_{block}").bitwiseAND(F.col(f"restart_{block}"))
    return F.when(F.col("client_id").isNotNull() & F.col("product").isNotNull(), both).otherwise(F.lit(0).cast("long"))


def lost(block: int) -> Column:
    """Months in which a key ended and was not renewed."""
    return F.col(f"ended_{block}").bitwiseAND(F.bitwise_not(renewed(block)))


def renewed_months(contracts: DataFrame, clients: DataFrame, window: Window, keep: Column) -> DataFrame:
    """``client_id, product`` of the keys that were renewed, with the masks ``renewed_0``, … of their months.

    ``keep`` is a rule on the product.
    """
    masks = key_masks(contracts.filter(keep), clients, window)
    some = reduce(Column.bitwiseOR, [renewed(b) for b in blocks(window)])
    return masks.filter(some != 0).select("client_id", "product", *[renewed(b).alias(f"renewed_{b}") for b in blocks(window)])


def base_and_lost(contracts: DataFrame, clients: DataFrame, window: Window) -> DataFrame:
    """``month, plan, active_clients, lost_clients``: the base at each month's start, and its losses in the month.

    Rows are those of the base: ``active_by_plan_month`` with the clients of
    ``lost_by_plan_month`` (0 where there are none), from one pass over the
    contracts.  The base keeps one-off items, the losses do not.
    """
    masks = key_masks(contracts.filter(rules.is_base_plan_line("product")), clients, window)
    plan = F.lower(rules.plan_of("product"))
    # A NULL product is no base plan line, so the rule on one-off items is never NULL here.
    gone = lambda b: F.when(rules.is_recurring("product"), lost(b)).otherwise(F.lit(0).cast("long"))
    both = [(F.bit_or(f"active_{b}").alias(f"active_{b}"), F.bit_or(gone(b)).alias(f"lost_{b}")) for b in blocks(window)]
    per_plan = masks.groupBy("client_id", plan.alias("plan")).agg(*[c for pair in both for c in pair])

    def months(b: int) -> Column:
        active, off = F.col(f"active_{b}"), F.col(f"lost_{b}")
        size = min(BLOCK, window.months + 1 - b * BLOCK)
        used = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: has(active.bitwiseOR(off), i))
        return F.transform(used, lambda i: F.struct((i + b * BLOCK).alias("slot"), has(active, i).alias("active"), has(off, i).alias("lost")))

    each = per_plan.select("client_id", "plan", F.inline(F.concat(*[months(b) for b in blocks(window)])))
    counted = each.groupBy("slot", "plan").agg(
        F.count(F.when(F.col("active"), F.col("client_id"))).alias("active_clients"),
        F.count(F.when(F.col("lost"), F.col("client_id"))).alias("lost_clients"),
        F.max("active").alias("in_base"),
    )
    return counted.filter("in_base").select(F.add_months(F.lit(window.lo), F.col("slot")).alias("month"), "plan", "active_clients", "lost_clients")
