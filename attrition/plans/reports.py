"""Report frames: what the dashboard shows, as DataFrames.

Every function here takes the (already aggregated) datasets, whose size is
bounded by construction — at most 16 months × 4 modules or 7 plans — so the
global orderings and the single-partition windows below act on a few dozen
rows, never on line-level data.  Money arrives as exact DECIMAL sums
(``exact=True`` datasets) and is cast to DOUBLE on output.

Semantics kept from the source on purpose:

* monthly client totals are *sums of per-module distinct counts*, so a client
  lost from two modules, or in two months, counts twice;
* "last month" of the KPI row includes the running month, while the
  base-vs-lost frame and the strip use the last *complete* month;
* "previous" is the previous month present, not the previous calendar month;
* the loss rate is ``lost / active * 100`` (division first), rounded to two
  decimals half-even on the binary value, and NULL when the base is 0;
* the rate join is left from the base: a lost plan-month without a base row
  disappears, a base plan-month without losses gets 0.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attrition.functions import formats, rules
from attrition.functions.dates import first_of_month, months_after_cutoff
from attrition.plans.datasets import sort_detail
from attrition.plans.ordering import order_bounded


# -- labels -----------------------------------------------------------------


def label_dimension(spark: SparkSession, labels: list[tuple[str, str]], code: str) -> DataFrame:
    """Small dimension ``(series_ord, <code>, label)`` in display order."""
    rows = [(i, c, lbl) for i, (c, lbl) in enumerate(labels)]
    return spark.createDataFrame(rows, f"series_ord int, {code} string, label string")


def label_of(code: Column | str, labels: list[tuple[str, str]]) -> Column:
    """``labels.get(code, code)`` as a map-literal lookup (no join)."""
    code = F.col(code) if isinstance(code, str) else code
    mapping = F.create_map(*[x for c, lbl in labels for x in (F.lit(c), F.lit(lbl))])
    return F.coalesce(F.element_at(mapping, code), code)


def series_ord(code: Column | str, labels: list[tuple[str, str]]) -> Column:
    """0-based position of ``code`` in ``labels`` (NULL if absent)."""
    code = F.col(code) if isinstance(code, str) else code
    codes = F.array(*[F.lit(c) for c, _ in labels])
    return (F.array_position(codes, code) - 1).cast("int")


# -- filters ----------------------------------------------------------------


def last_n_months(df: DataFrame, as_of: date, n_months: int, col: str = "month") -> DataFrame:
    """Keep rows with ``col >= as_of − n months`` (day precision); 0 keeps all.

    A text column is parsed; text that is no date drops its row (0 still keeps all).
    """
    text = isinstance(df.schema[col].dataType, StringType)
    return df.filter(months_after_cutoff(col, as_of, n_months, lenient=text))


def module_members(by_module: DataFrame) -> DataFrame:
    """Only modules with a chart label (drops ``base``)."""
    return by_module.filter(F.col("module").isin([c for c, _ in rules.MODULE_LABELS]))


def complete_months(df: DataFrame, as_of: date) -> DataFrame:
    return df.filter(F.col("month") < F.lit(first_of_month(as_of)))


# -- totals and KPI ----------------------------------------------------------


def _month_sums(by_module: DataFrame) -> DataFrame:
    return by_module.groupBy("month").agg(
        F.coalesce(F.sum("lost_amount"), F.lit(0)).alias("lost_amount"),
        F.coalesce(F.sum("lost_clients"), F.lit(0)).cast("long").alias("lost_clients"),
    )


def monthly_totals(by_module: DataFrame) -> DataFrame:
    """Per month: summed amount and summed distinct counts over modules."""
    out = _month_sums(by_module).select(
        "month", formats.month_label("month").alias("month_label"), "lost_amount", "lost_clients"
    )
    return order_bounded(out, "month")


def period_totals(by_module: DataFrame) -> DataFrame:
    """One row: whole-period amount and summed counts (0 when empty)."""
    return by_module.agg(
        F.coalesce(F.sum("lost_amount"), F.lit(0)).alias("lost_amount"),
        F.coalesce(F.sum("lost_clients"), F.lit(0)).cast("long").alias("lost_clients"),
    )


def _latest(c: str, n: int) -> Column:
    """Value of ``c`` in the n-th last month present; NULL without one."""
    return F.get(f"_months.{c}", F.lit(n - 1))


def _months() -> Column:
    """Aggregate: the months (at most the window's), latest first.

    Arrays of structs merge across tasks, so this is no window over a single
    partition.
    """
    return F.sort_array(F.collect_list(F.struct("month", "lost_amount", "lost_clients")), asc=False).alias("_months")


def latest_previous(totals: DataFrame) -> DataFrame:
    """One row: value in the last month present, in the one before, and the difference."""
    one = totals.agg(_months()).select(
        _latest("month", 1).alias("last_month"),
        _latest("lost_amount", 1).alias("last_amount"),
        _latest("lost_amount", 2).alias("prev_amount"),
        _latest("lost_clients", 1).alias("last_clients"),
        _latest("lost_clients", 2).alias("prev_clients"),
    )
    return one.withColumn("delta_amount", F.col("last_amount") - F.col("prev_amount")).withColumn(
        "delta_clients", F.col("last_clients") - F.col("prev_clients")
    )


def kpi_summary(by_module: DataFrame) -> DataFrame:
    """KPI row: last-month and period amount/clients, deltas, and display texts."""
    totals = _month_sums(by_module).agg(
        _months(),
        F.coalesce(F.sum("lost_amount"), F.lit(0)).alias("period_amount"),
        F.coalesce(F.sum("lost_clients"), F.lit(0)).cast("long").alias("period_clients"),
    )
    row = totals.select(
        _latest("month", 1).alias("last_month"),
        _latest("lost_amount", 1).alias("last_amount"),
        (_latest("lost_amount", 1) - _latest("lost_amount", 2)).alias("delta_amount"),
        "period_amount",
        _latest("lost_clients", 1).alias("last_clients"),
        (_latest("lost_clients", 1) - _latest("lost_clients", 2)).alias("delta_clients"),
        "period_clients",
    )
    return row.select(
        "last_month",
        F.col("last_amount").cast("double").alias("last_amount"),
        F.col("delta_amount").cast("double").alias("delta_amount"),
        F.col("period_amount").cast("double").alias("period_amount"),
        "last_clients",
        "delta_clients",
        "period_clients",
        formats.truthy_or_dash(
            "last_amount", F.concat(F.lit(formats.CURRENCY_PREFIX), formats.brl("last_amount"))
        ).alias("last_amount_text"),
        formats.signed("delta_amount", 2, formats.CURRENCY_SUFFIX).alias("delta_amount_text"),
        F.concat(F.lit(formats.CURRENCY_PREFIX), formats.brl("period_amount")).alias("period_amount_text"),
        formats.truthy_or_dash("last_clients", formats.dotted_int("last_clients")).alias(
            "last_clients_text"
        ),
        formats.signed("delta_clients", 0).alias("delta_clients_text"),
        formats.dotted_int("period_clients").alias("period_clients_text"),
    )


def format_amounts(totals: DataFrame) -> DataFrame:
    """Per month: amount texts (2 and 0 decimals), count text, signed deltas vs previous month present."""
    prev = W.orderBy("month")  # ≤16 rows
    d_amt = F.col("lost_amount") - F.lag("lost_amount").over(prev)
    d_cli = F.col("lost_clients") - F.lag("lost_clients").over(prev)
    return totals.select(
        "month",
        F.concat(F.lit(formats.CURRENCY_PREFIX), formats.brl("lost_amount", 2)).alias("amount_text"),
        F.concat(F.lit(formats.CURRENCY_PREFIX), formats.brl("lost_amount", 0)).alias("bar_text"),
        formats.dotted_int("lost_clients").alias("clients_text"),
        formats.signed(d_amt, 2, formats.CURRENCY_SUFFIX).alias("delta_amount_text"),
        formats.signed(d_cli, 0).alias("delta_clients_text"),
    )


def month_axis(df: DataFrame) -> DataFrame:
    """Distinct ``(month, month_label)`` in month order: the category axis."""
    axis = df.select("month", formats.month_label("month").alias("month_label")).distinct()
    return order_bounded(axis, "month")


# -- chart series -------------------------------------------------------------


def series(df: DataFrame, code: str, labels: list[tuple[str, str]], measure: str) -> DataFrame:
    """Long-format series: one row per (label, month) in label order, then month."""
    known = df.filter(F.col(code).isin([c for c, _ in labels]))
    out = known.select(
        series_ord(code, labels).alias("series_ord"),
        code,
        label_of(code, labels).alias("label"),
        "month",
        formats.month_label("month").alias("month_label"),
        F.col(measure),
    )
    return order_bounded(out, "series_ord", "month")


def series_wide(df: DataFrame, code: str, labels: list[tuple[str, str]], measure: str) -> DataFrame:
    """One row per month, one column per code (label order); NULL where absent.

    The codes are listed, so ``pivot`` needs no extra job to discover them.
    """
    codes = [c for c, _ in labels]
    wide = df.groupBy("month").pivot(code, codes).agg(F.sum(measure))
    return order_bounded(wide.select("month", *codes), "month")


# -- loss rate ----------------------------------------------------------------


def loss_pct(lost: Column | str, active: Column | str) -> Column:
    """``round(lost / active * 100, 2)``, half-even on the binary value; NULL for base 0."""
    lost = F.col(lost) if isinstance(lost, str) else lost
    active = F.col(active) if isinstance(active, str) else active
    x = F.try_divide(lost.cast("double"), active.cast("double")) * F.lit(100.0)
    return F.rint(x * F.lit(100.0)) / F.lit(100.0)


def loss_rate(active_by_plan: DataFrame, lost_by_plan: DataFrame) -> DataFrame:
    """Base ⟕ losses on (month, plan), losses NULL-filled with 0, then the rate.

    Both sides are aggregated frames of at most 16 × 7 rows; the loss side is
    broadcast on that bound.
    """
    lost = lost_by_plan.select("month", "plan", "lost_clients")
    joined = active_by_plan.join(F.broadcast(lost), ["month", "plan"], "left")
    rate = joined.select(
        "month",
        "plan",
        "active_clients",
        F.coalesce(F.col("lost_clients"), F.lit(0)).cast("long").alias("lost_clients"),
    )
    return with_rate(rate)


def with_rate(base_and_lost: DataFrame) -> DataFrame:
    """``month, plan, active_clients, lost_clients`` with ``loss_pct``, in order."""
    rate = base_and_lost.withColumn("loss_pct", loss_pct("lost_clients", "active_clients"))
    return order_bounded(rate, "month", "plan")


def series_loss_pct(rate: DataFrame) -> DataFrame:
    """Loss % per plan and month, in label order, skipping plans whose base sums to 0."""
    base_total = F.sum("active_clients").over(W.partitionBy("plan"))
    kept = rate.withColumn("_base", base_total).filter(F.col("_base") != 0)
    return series(kept, "plan", rules.PLAN_LABELS, "loss_pct")


def latest_complete_month(rate: DataFrame, as_of: date) -> DataFrame:
    """One row: the last month before the running one, else the last month present."""
    m0 = F.lit(first_of_month(as_of))
    return rate.agg(
        F.coalesce(F.max(F.when(F.col("month") < m0, F.col("month"))), F.max("month")).alias("month")
    )


def at_latest_complete_month(rate: DataFrame, as_of: date) -> DataFrame:
    """Rows of ``rate`` at its last complete month (fallback: last month present).

    One aggregate holds the month and the rows (≤ 16 × 7), so the frame is
    computed once instead of joined with its own aggregate.
    """
    m0 = F.lit(first_of_month(as_of))
    one = rate.agg(
        F.coalesce(F.max(F.when(F.col("month") < m0, F.col("month"))), F.max("month")).alias("_latest"),
        F.collect_list(F.struct(*rate.columns)).alias("_rows"),
    )
    return one.select(F.inline(F.filter("_rows", lambda r: r["month"] == F.col("_latest"))))


def base_vs_lost_latest(rate: DataFrame, as_of: date) -> DataFrame:
    """Per plan at the last complete month: base and lost clients, with labels."""
    out = at_latest_complete_month(rate, as_of).select(
        "month",
        "plan",
        label_of("plan", rules.PLAN_LABELS).alias("label"),
        "active_clients",
        "lost_clients",
    )
    return order_bounded(out, "plan")


def plan_strip(spark: SparkSession, rate: DataFrame, as_of: date) -> DataFrame:
    """One cell per known plan, in label order: ``12.3%`` or a dash when missing or base 0."""
    at = at_latest_complete_month(rate, as_of).select("plan", "active_clients", "loss_pct")
    # Both sides are bounded (7 labels; ≤ 7 plans in one month).
    cells = label_dimension(spark, rules.PLAN_LABELS, "plan").join(F.broadcast(at), "plan", "left")
    text = F.when(
        F.col("active_clients").isNull() | (F.col("active_clients") == 0), F.lit(formats.DASH)
    ).otherwise(F.coalesce(formats.percent_1("loss_pct"), F.lit(formats.DASH)))
    out = cells.select("series_ord", "plan", "label", "loss_pct", text.alias("loss_pct_text"))
    return order_bounded(out, "series_ord")


# -- detail table ---------------------------------------------------------------


def detail_projection(detail: DataFrame) -> DataFrame:
    """The six shown columns, in order (``client_id`` dropped, name shown)."""
    return detail.select(
        "month",
        "module",
        "plan",
        F.col("client_name").alias("client"),
        "product",
        "lost_amount",
    )


def detail_table(detail: DataFrame, as_of: date, n_months: int) -> DataFrame:
    """Detail for the selected period, in detail order, with month and amount as shown too.

    ``month`` stays a date, so a stored copy can be sorted again.  The period filter runs before the (distributed) sort, so only kept rows
    are sorted; ``detail`` may come sorted or not.
    """
    kept = sort_detail(last_n_months(detail, as_of, n_months))
    shown = detail_projection(kept)
    return shown.select(
        "*", formats.month_label("month").alias("month_label"), formats.plain_amount("lost_amount").alias("amount_text")
    )
