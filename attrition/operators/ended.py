"""Ended contract lines, renewals, and the net lost lines.

``ended_contracts`` (one row per line that ended in the trailing window) is the
union of two disjoint branches (split on ``end_date IS NULL``):

* closed lines: the line's end, overridden by the client cancellation date
  denormalised on the line when present;
* open lines of clients whose cancellation (from ``clients``) falls in the
  window: one line per (client, product), the one that started last.

A line is *renewed* when it ended on a month's last day and the same client
and product has any contract starting in the next calendar month.  The
renewal test is on the key ``(client_id, product, month)``, not on the line:
one month-end renewal removes every ended line of that key.  Renewal evidence
is looked up in the *unfiltered* contracts (any row, whatever its end date,
amount or product class).

Plans at scale.  The grouped datasets rest on ``key_totals``: a single scan of
the contracts emits a tagged row for a line's end and one for its start, and one
aggregation per ``(client_id, product, month)`` (partial first: a hot key
collapses in each map task) holds the key's amount, whether a line of it ended
on a month end, and whether it restarted; the keys that are not renewed are read
from it, without any join.  The detail (``net.net_lost``) drops its lines by
the months of ``key_masks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions import dates, rules
from attrition.functions.dates import Window
from attrition.operators.latest import latest_per_key

KEY = ["client_id", "product", "month"]


def line_rule(base_plan_only: bool) -> Column:
    """Whether a line may count as lost: a rule on its product."""
    keep = rules.is_recurring("product")
    if base_plan_only:
        keep = keep & rules.is_base_plan_line("product")
    return keep


def closes(contracts: DataFrame, window: Window) -> Column:
    """Whether a line has an end date and its effective end falls in the window.

    Same predicate as ``window.contains(coalesce(cancel, end))``, spelled so
    that each side is a plain column range the Parquet reader can use.
    """

    def test(day):
        cancel, end = day("cancel_date"), day("end_date")
        in_window = cancel.between(window.lo, window.hi) | (cancel.missing() & end.between(window.lo, window.hi))
        return end.present() & in_window

    return dates.on_days(contracts, test)


def restarts(contracts: DataFrame, window: Window) -> Column:
    """Whether a line starts in a month after one of the window's."""
    first = dates.shift_months(window.lo, 1)
    last = dates.last_of_month(dates.shift_months(window.month0, 1))
    return dates.on_days(contracts, lambda day: day("start_date").between(first, last))


def cancelled_in(clients: DataFrame, window: Window) -> DataFrame:
    """``client_id, ended_on`` of the cancellations in the window."""
    inside = dates.on_days(clients, lambda day: day("cancel_date").between(window.lo, window.hi))
    return clients.filter(inside).select("client_id", F.col("cancel_date").alias("ended_on"))


def closed_ended(contracts: DataFrame, window: Window, base_plan_only: bool = False) -> DataFrame:
    """Lines with an end date whose effective end falls in the window."""
    ended_on = dates.effective_end("cancel_date", "end_date")
    return contracts.filter(closes(contracts, window) & line_rule(base_plan_only)).select(
        "client_id",
        "product",
        ended_on.alias("ended_on"),
        dates.month_bucket(ended_on).alias("month"),
        "amount",
    )


def open_cancelled(
    contracts: DataFrame,
    clients: DataFrame,
    window: Window,
    base_plan_only: bool = False,
    distinct_clients: bool = False,
) -> DataFrame:
    """Open lines of clients cancelled in the window (inner join, before de-duplication).

    The line takes the client's cancellation date as its end.  Duplicate
    client rows fan out here; ``latest_per_key`` collapses them.  Spark
    broadcasts the cancelled clients (a filtered slice of the dimension) when
    their measured bytes allow.  ``distinct_clients`` drops exact
    copies of a (client, cancellation) pair first — harmless before the
    latest-line rule (a maximum), and it stops a client listed many times
    from multiplying its lines.
    """
    cancelled = cancelled_in(clients, window)
    if distinct_clients:
        cancelled = cancelled.distinct()
    is_open = dates.on_days(contracts, lambda day: day("end_date").missing())
    lines = contracts.filter(is_open & line_rule(base_plan_only)).select(
        "client_id", "product", "start_date", "amount"
    )
    return lines.join(cancelled, "client_id", "inner").select(
        "client_id", "product", "start_date", "ended_on", "amount"
    )


def latest_open_cancelled(
    contracts: DataFrame, clients: DataFrame, window: Window, base_plan_only: bool = False
) -> DataFrame:
    """One open line per (client, product): latest start, then highest amount."""
    return latest_per_key(
        open_cancelled(contracts, clients, window, base_plan_only, distinct_clients=True),
        ["client_id", "product"],
        ["start_date", "amount"],
    )


def ended_contracts(
    contracts: DataFrame, clients: DataFrame, window: Window, base_plan_only: bool = False
) -> DataFrame:
    """Closed branch ⊎ open branch (UNION ALL; the branches are disjoint)."""
    closed = closed_ended(contracts, window, base_plan_only)
    latest = latest_open_cancelled(contracts, clients, window, base_plan_only)
    open_ = latest.select(
        "client_id",
        "product",
        "ended_on",
        dates.month_bucket("ended_on").alias("month"),
        "amount",
    )
    return closed.unionByName(open_)


def restarted_keys(contracts: DataFrame, window: Window | None = None) -> DataFrame:
    """Distinct ``(client_id, product, month)`` such that a contract starts in the month after ``month``.

    ``window`` (optional) bounds the start dates worth reading (the months
    after the window's months), which lets the scan of ``contracts`` skip data.
    """
    starts = contracts.filter(F.col("start_date").isNotNull() if window is None else restarts(contracts, window))
    # "starts in the month after m"  ⇔  m = (month of start) − 1 month.
    return starts.select(
        "client_id",
        "product",
        F.add_months(dates.month_bucket("start_date"), -1).alias("month"),
    ).distinct()


def renewal_keys(ended: DataFrame, contracts: DataFrame, window: Window | None = None) -> DataFrame:
    """Distinct ``(client_id, product, month)`` of month-end lines restarted next month.

    ``window`` (optional) is the window ``ended`` was cut with.
    """
    month_end = ended.filter(dates.is_month_end("ended_on")).select(*KEY).distinct()
    return month_end.join(restarted_keys(contracts, window), KEY, "left_semi")


def drop_renewed(ended: DataFrame, keys: DataFrame) -> DataFrame:
    """Ended lines whose key is not a renewal key (NULL keys never match, so stay)."""
    return ended.join(keys, KEY, "left_anti")


def key_totals(
    contracts: DataFrame, clients: DataFrame, window: Window, base_plan_only: bool = False
) -> DataFrame:
    """``client_id, product, month, amount, ended, month_end, restarted`` per key.

    ``ended`` counts the key's ended lines; a key of restarts alone has none.
    Starts count whatever the line's end, amount or class (unfiltered evidence).
    """
    cancel, end, start = F.col("cancel_date"), F.col("end_date"), F.col("start_date")
    ended_on = dates.effective_end(cancel, end)
    closed, starts = closes(contracts, window) & line_rule(base_plan_only), restarts(contracts, window)

    def tag(month: Column, amount: Column, ended: int, month_end: Column, restarted: bool) -> Column:
        parts = (month, amount, F.lit(ended), month_end, F.lit(restarted))
        return F.struct(*[c.alias(n) for c, n in zip(parts, ("month", "amount", "ended", "month_end", "restarted"), strict=True)])

    nothing = F.lit(None).cast(contracts.schema["amount"].dataType)
    end_row = F.when(closed, tag(dates.month_bucket(ended_on), F.col("amount"), 1, dates.is_month_end(ended_on), False))
    start_row = F.when(starts, tag(F.add_months(dates.month_bucket(start), -1), nothing, 0, F.lit(False), True))
    tagged = contracts.filter(closed | starts).select("client_id", "product", F.explode(F.array_compact(F.array(end_row, start_row))).alias("t"))
    lines = tagged.select("client_id", "product", "t.*")
    latest = latest_open_cancelled(contracts, clients, window, base_plan_only)
    open_lines = latest.select(
        "client_id",
        "product",
        tag(dates.month_bucket("ended_on"), F.col("amount"), 1, dates.is_month_end("ended_on"), False).alias("t"),
    ).select("client_id", "product", "t.*")
    return (
        lines.unionByName(open_lines)
        .groupBy(*KEY)
        .agg(
            F.sum("amount").alias("amount"),
            F.sum("ended").alias("ended"),
            F.max("month_end").alias("month_end"),
            F.max("restarted").alias("restarted"),
        )
    )


#: A key with a NULL part matches no restart, so it is never renewed.
RENEWED = "month_end AND restarted AND client_id IS NOT NULL AND product IS NOT NULL"


def net_lost_per_key(
    contracts: DataFrame, clients: DataFrame, window: Window, base_plan_only: bool = False
) -> DataFrame:
    """Net lost amount per ``(client_id, product, month)`` (input of the grouped datasets).

    Equal to ``net_lost(...).groupBy(KEY).agg(sum(amount))``.  Module and plan
    are functions of ``product``, so per-(month, module/plan) distinct clients
    and sums are unchanged by the pre-aggregation.
    """
    totals = key_totals(contracts, clients, window, base_plan_only)
    return totals.filter(f"ended > 0 AND NOT coalesce({RENEWED}, false)").select(*KEY, "amount")
