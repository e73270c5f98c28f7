"""Active base at the start of each calendar month (interval stabbing).

The question "which lines are active on the first day of month t, for each t
in the calendar" is a range join of a 16-row calendar against the fact.  Here
it is done per row instead: each line computes the first and last calendar
month it covers and ``explode(sequence(...))`` emits exactly those months.
That is linear in the input, needs no join and no broadcast, and emits only
matching pairs (a nested-loop join would test all of them).

Month t is covered iff ``start <= t`` and (``end`` is NULL or ``end > t``):

* first covered month = ``start`` if it is a first-of-month, else the next one;
* last covered month  = month of ``end − 1 day`` (t < end ⇔ t <= end − 1).

Both are clamped to the calendar; lines with an empty range are filtered out
before ``sequence`` (which raises when lo > hi), and lines without a start are
dropped explicitly (``greatest`` would ignore the NULL).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions import dates
from attrition.functions.dates import Window, month_bucket


#: Months a mask holds (``2^(hi+1) − 2^lo`` must stay within a signed long).
BLOCK = 60


def covered_months(df: DataFrame, window: Window) -> tuple:
    s, e = F.col("start_date"), F.col("end_date")
    cal_lo, cal_hi = F.lit(window.lo), F.lit(window.month0)
    first = F.when(F.dayofmonth(s) == 1, s).otherwise(F.add_months(month_bucket(s), 1))
    lo = F.greatest(cal_lo, first)
    hi = F.when(e.isNull(), cal_hi).otherwise(F.least(cal_hi, month_bucket(F.date_sub(e, 1))))
    return lo, hi


def touches(contracts: DataFrame, window: Window) -> Column:
    """Necessary for a line to be active in the calendar; literal bounds prune row groups at the scan."""

    def test(day):
        start, end = day("start_date"), day("end_date")
        return start.present() & start.until(window.month0) & (end.missing() | end.after(window.lo))

    return dates.on_days(contracts, test)


def active_intervals(contracts: DataFrame, window: Window, keep: list[str] | None = None) -> DataFrame:
    """One row per (calendar month, line active on its first day): ``month`` + ``keep`` columns."""
    keep = keep or ["client_id", "product", "amount"]
    lo, hi = covered_months(contracts, window)
    spans = (
        contracts.filter(touches(contracts, window))
        .select(*keep, lo.alias("_lo"), hi.alias("_hi"))
        .filter(F.col("_lo") <= F.col("_hi"))
    )
    return spans.select(
        F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("month"), *keep
    )


def month_index(d: Column, origin: date) -> Column:
    """Whole months from ``origin`` (a first-of-month date literal) to the month of ``d``."""
    return (F.year(d) * 12 + F.month(d)) - (origin.year * 12 + origin.month)


def active_counts(
    contracts: DataFrame, window: Window, group: str, entity: str = "client_id"
) -> DataFrame:
    """``count(distinct entity)`` of lines active on each calendar month's first day, per ``group``.

    Same result as ``active_intervals(...).groupBy('month', group)
    .agg(count_distinct(entity))``, computed without exploding every line:

    1. each line becomes a bit mask of the calendar months it covers
       (bit i = month ``window.lo + i`` of the mask's block);
    2. masks are OR-ed per (entity, group) — a fixed-width hash aggregate
       that Spark pre-aggregates map-side, so an entity holding a large share
       of the lines is collapsed before the shuffle;
    3. only the set bits of each (entity, group) are expanded (≤ 16 rows per
       pair instead of ≤ 16 per line) and counted per (month, group).

    An entity counts once per month because it occurs once per (entity,
    group).  NULL entities form one group whose months still appear, with a
    count of 0 (``count`` skips NULL), as ``count(distinct)`` would give.  A
    mask holds ``BLOCK`` months; a line that reaches into several blocks of the
    calendar has a mask for each.
    """
    lo, hi = covered_months(contracts, window)
    first, last = month_index(F.col("_lo"), window.lo), month_index(F.col("_hi"), window.lo)
    spans = (
        contracts.filter(touches(contracts, window))
        .select(entity, group, lo.alias("_lo"), hi.alias("_hi"))
        .filter(F.col("_lo") <= F.col("_hi"))
        .select(entity, group, first.alias("_first"), last.alias("_last"))
    )
    blocks = F.sequence(F.floor(F.col("_first") / BLOCK).cast("int"), F.floor(F.col("_last") / BLOCK).cast("int"))
    cut = spans.select(entity, group, "_first", "_last", F.explode(blocks).alias("_block"))
    low = F.greatest(F.col("_first") - F.col("_block") * BLOCK, F.lit(0))
    high = F.least(F.col("_last") - F.col("_block") * BLOCK, F.lit(BLOCK - 1))
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, high + 1) - F.call_function("shiftleft", one, low)
    per_entity = (
        cut.select(entity, group, "_block", mask.alias("_mask"))
        .groupBy(entity, group, "_block")
        .agg(F.bit_or("_mask").alias("_mask"))
    )
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(BLOCK - 1)),
        lambda i: F.call_function("shiftright", F.col("_mask"), i).bitwiseAND(F.lit(1)) == 1,
    )
    months = per_entity.select(entity, group, "_block", F.explode(bits).alias("_i"))
    month = F.add_months(F.lit(window.lo), F.col("_block") * BLOCK + F.col("_i"))
    return months.groupBy(month.alias("month"), group).agg(F.count(entity).alias("active"))
