"""Registered queries: ``key -> callable(spark, sf_dir) -> DataFrame``.

One key per operator of the inventory.  Each is written once as a function of
``(spark, contracts, clients)`` (``OPERATORS``, used by the randomized tests)
and wrapped to read the test tables through the fixture adapter
(``QUERIES``), with the fixed parameters below (``as_of``
replaces "today"; the window is 15 months plus the running one; the report
period is the last 15 months).  Amounts come out as DOUBLE, counts as
BIGINT, dates as DATE.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.functions import dates, rules
from attrition.functions.dates import Window
from attrition.operators import active, ended
from attrition.operators.key_masks import base_and_lost
from attrition.operators.net import net_lost
from attrition.plans import datasets, reports
from attrition.plans import sql as sql_spelling
from attrition.sources import fixtures

AS_OF = date(2001, 6, 15)
WINDOW_MONTHS = 15
N_MONTHS = 15
WINDOW = Window(AS_OF, WINDOW_MONTHS)

Query = Callable[[SparkSession, str], DataFrame]
Operator = Callable[[SparkSession, DataFrame, DataFrame], DataFrame]

# key -> (spark, sf_dir) -> DataFrame: reads the test tables via the adapter.
QUERIES: dict[str, Query] = {}
# key -> (spark, contracts, clients) -> DataFrame: the same query on any inputs.
OPERATORS: dict[str, Operator] = {}


def _on_test_tables(op: Operator) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        contracts, clients = fixtures.derive(spark, sf_dir)
        return op(spark, contracts, clients)

    run.__name__ = op.__name__
    run.__doc__ = op.__doc__
    return run


def register(key: str):
    def deco(op: Operator) -> Operator:
        OPERATORS[key] = op
        QUERIES[key] = _on_test_tables(op)
        return op

    return deco


def _money(df: DataFrame, *cols: str) -> DataFrame:
    cols = cols or ("amount",)
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# -- sources -------------------------------------------------------------------


@register("scan_contracts")
def q_scan_contracts(spark, contracts, clients):
    return _money(contracts)


@register("scan_clients")
def q_scan_clients(spark, contracts, clients):
    return clients


# -- projections -----------------------------------------------------------------


@register("effective_end_date")
def q_effective_end_date(spark, contracts, clients):
    return contracts.select(
        "client_id", "product", "end_date", "cancel_date",
        dates.effective_end("cancel_date", "end_date").alias("ended_on"),
    )


@register("month_bucket")
def q_month_bucket(spark, contracts, clients):
    return contracts.select(
        "client_id", "product", "start_date",
        dates.month_bucket("start_date").alias("start_month"),
        "end_date",
        dates.month_bucket("end_date").alias("end_month"),
    )


@register("classify_module")
def q_classify_module(spark, contracts, clients):
    return contracts.select("client_id", "product", rules.module_of("product").alias("module"))


@register("classify_module_display")
def q_classify_module_display(spark, contracts, clients):
    return contracts.select("client_id", "product", rules.module_display_of("product").alias("module"))


@register("classify_plan")
def q_classify_plan(spark, contracts, clients):
    return contracts.select("client_id", "product", rules.plan_of("product").alias("plan"))


@register("fold_codes")
def q_fold_codes(spark, contracts, clients):
    return contracts.select(
        "client_id", "product",
        F.lower(rules.module_of("product")).alias("module"),
        F.upper(rules.plan_of("product")).alias("plan"),
    )


@register("name_fallback")
def q_name_fallback(spark, contracts, clients):
    return clients.select(
        "client_id", F.coalesce(F.col("client_name"), F.col("client_id")).alias("client_name")
    )


@register("scalar_dates")
def q_scalar_dates(spark, contracts, clients):
    s = F.col("start_date")
    return contracts.select(
        "client_id", "product", "start_date",
        dates.to_date(s.cast("string")).alias("parsed"),
        dates.month_bucket(s).alias("start_month"),
        F.add_months(s, 1).alias("plus_one_month"),
        F.add_months(s, -1).alias("minus_one_month"),
        F.last_day(s).alias("month_end"),
    )


# -- filters -------------------------------------------------------------------


@register("split_open_closed")
def q_split_open_closed(spark, contracts, clients):
    return contracts.select("client_id", "product", "end_date", F.col("end_date").isNull().alias("is_open"))


@register("trailing_window")
def q_trailing_window(spark, contracts, clients):
    ended_on = dates.effective_end("cancel_date", "end_date")
    return contracts.filter(WINDOW.contains(ended_on)).select(
        "client_id", "product", ended_on.alias("ended_on")
    )


@register("exclude_one_off")
def q_exclude_one_off(spark, contracts, clients):
    return _money(contracts.filter(rules.is_recurring("product")).select("client_id", "product", "amount"))


@register("exclude_modules")
def q_exclude_modules(spark, contracts, clients):
    return _money(
        contracts.filter(rules.is_base_plan_line("product")).select("client_id", "product", "amount")
    )


@register("is_month_end")
def q_is_month_end(spark, contracts, clients):
    return contracts.select(
        "client_id", "product", "end_date", dates.is_month_end("end_date").alias("ends_month_end")
    )


@register("active_at")
def q_active_at(spark, contracts, clients):
    return contracts.filter(dates.active_at("start_date", "end_date", WINDOW.month0)).select(
        "client_id", "product", "start_date", "end_date"
    )


# -- joins, windows, set operations ------------------------------------------------


@register("open_cancelled")
def q_open_cancelled(spark, contracts, clients):
    return _money(ended.open_cancelled(contracts, clients, WINDOW))


@register("latest_per_key")
def q_latest_per_key(spark, contracts, clients):
    return _money(ended.latest_open_cancelled(contracts, clients, WINDOW))


@register("ended_contracts")
def q_ended_contracts(spark, contracts, clients):
    return _money(ended.ended_contracts(contracts, clients, WINDOW))


@register("ended_contracts_base_plan")
def q_ended_contracts_base_plan(spark, contracts, clients):
    return _money(ended.ended_contracts(contracts, clients, WINDOW, base_plan_only=True))


@register("renewal_keys")
def q_renewal_keys(spark, contracts, clients):
    d0 = ended.ended_contracts(contracts, clients, WINDOW)
    return ended.renewal_keys(d0, contracts, WINDOW)


@register("drop_renewed")
def q_drop_renewed(spark, contracts, clients):
    return _money(net_lost(contracts, clients, WINDOW))


@register("active_intervals")
def q_active_intervals(spark, contracts, clients):
    return _money(active.active_intervals(contracts, WINDOW))


# -- datasets -------------------------------------------------------------------------


@register("lost_by_module_month")
def q_lost_by_module_month(spark, contracts, clients):
    return datasets.lost_by_module_month(contracts, clients, WINDOW)


@register("lost_by_module_month_sql")
def q_lost_by_module_month_sql(spark, contracts, clients):
    return sql_spelling.lost_by_module_month(contracts, clients, WINDOW)


@register("lost_by_plan_month")
def q_lost_by_plan_month(spark, contracts, clients):
    return datasets.lost_by_plan_month(contracts, clients, WINDOW)


@register("lost_detail")
def q_lost_detail(spark, contracts, clients):
    return datasets.lost_detail(contracts, clients, WINDOW)


@register("active_by_plan_month")
def q_active_by_plan_month(spark, contracts, clients):
    return datasets.active_by_plan_month(contracts, WINDOW)


# -- report frames ---------------------------------------------------------------------


def _by_module(contracts, clients, n_months: int = N_MONTHS, exact: bool = True) -> DataFrame:
    d1 = datasets.lost_by_module_month(contracts, clients, WINDOW, exact=exact)
    return reports.last_n_months(d1, AS_OF, n_months)


def _by_plan(contracts, clients, n_months: int = N_MONTHS, exact: bool = True) -> DataFrame:
    d2 = datasets.lost_by_plan_month(contracts, clients, WINDOW, exact=exact)
    return reports.last_n_months(d2, AS_OF, n_months)


def _rate(contracts, clients) -> DataFrame:
    return reports.with_rate(reports.last_n_months(base_and_lost(contracts, clients, WINDOW), AS_OF, N_MONTHS))


@register("last_n_months")
def q_last_n_months(spark, contracts, clients):
    return _by_module(contracts, clients, exact=False)


@register("last_n_months_3")
def q_last_n_months_3(spark, contracts, clients):
    return _by_module(contracts, clients, n_months=3, exact=False)


@register("last_n_months_all")
def q_last_n_months_all(spark, contracts, clients):
    return _by_module(contracts, clients, n_months=0, exact=False)


@register("last_n_months_text")
def q_last_n_months_text(spark, contracts, clients):
    """The period filter on months as text, some of which are no dates."""
    text = F.when(F.col("lost_clients") % 5 == 0, "oops").otherwise(F.col("month").cast("string"))
    d1 = datasets.lost_by_module_month(contracts, clients, WINDOW).withColumn("month", text)
    return reports.last_n_months(d1, AS_OF, N_MONTHS)


@register("kpi_summary_empty")
def q_kpi_summary_empty(spark, contracts, clients):
    """The key figures of a period without losses (it starts a century after the last)."""
    return reports.kpi_summary(_by_module(contracts, clients, n_months=-1200))


@register("module_members")
def q_module_members(spark, contracts, clients):
    return reports.module_members(_by_module(contracts, clients, exact=False))


@register("label_lookup")
def q_label_lookup(spark, contracts, clients):
    d2 = _by_plan(contracts, clients, exact=False)
    return d2.withColumn("label", reports.label_of("plan", rules.PLAN_LABELS))


@register("monthly_totals")
def q_monthly_totals(spark, contracts, clients):
    return _money(reports.monthly_totals(_by_module(contracts, clients)), "lost_amount")


@register("period_totals")
def q_period_totals(spark, contracts, clients):
    return _money(reports.period_totals(_by_module(contracts, clients)), "lost_amount")


@register("latest_previous")
def q_latest_previous(spark, contracts, clients):
    totals = reports.monthly_totals(_by_module(contracts, clients))
    return _money(reports.latest_previous(totals), "last_amount", "prev_amount", "delta_amount")


@register("kpi_summary")
def q_kpi_summary(spark, contracts, clients):
    return reports.kpi_summary(_by_module(contracts, clients))


@register("format_amounts")
def q_format_amounts(spark, contracts, clients):
    return reports.format_amounts(reports.monthly_totals(_by_module(contracts, clients)))


@register("month_axis")
def q_month_axis(spark, contracts, clients):
    return reports.month_axis(_by_module(contracts, clients))


@register("series_module_amount")
def q_series_module_amount(spark, contracts, clients):
    df = _money(_by_module(contracts, clients), "lost_amount")
    return reports.series(reports.module_members(df), "module", rules.MODULE_LABELS, "lost_amount")


@register("series_module_clients")
def q_series_module_clients(spark, contracts, clients):
    df = _by_module(contracts, clients)
    return reports.series(reports.module_members(df), "module", rules.MODULE_LABELS, "lost_clients")


@register("series_plan_amount")
def q_series_plan_amount(spark, contracts, clients):
    df = _money(_by_plan(contracts, clients), "lost_amount")
    return reports.series(df, "plan", rules.PLAN_LABELS, "lost_amount")


@register("series_plan_clients")
def q_series_plan_clients(spark, contracts, clients):
    return reports.series(_by_plan(contracts, clients), "plan", rules.PLAN_LABELS, "lost_clients")


@register("series_plan_amount_wide")
def q_series_plan_amount_wide(spark, contracts, clients):
    wide = reports.series_wide(_by_plan(contracts, clients), "plan", rules.PLAN_LABELS, "lost_amount")
    return _money(wide, *[c for c, _ in rules.PLAN_LABELS])


@register("loss_rate")
def q_loss_rate(spark, contracts, clients):
    return _rate(contracts, clients)


@register("complete_months")
def q_complete_months(spark, contracts, clients):
    return reports.complete_months(_rate(contracts, clients), AS_OF)


@register("series_loss_pct")
def q_series_loss_pct(spark, contracts, clients):
    return reports.series_loss_pct(_rate(contracts, clients))


@register("latest_complete_month")
def q_latest_complete_month(spark, contracts, clients):
    return reports.latest_complete_month(_rate(contracts, clients), AS_OF)


@register("base_vs_lost_latest")
def q_base_vs_lost_latest(spark, contracts, clients):
    return reports.base_vs_lost_latest(_rate(contracts, clients), AS_OF)


@register("plan_strip")
def q_plan_strip(spark, contracts, clients):
    return reports.plan_strip(spark, _rate(contracts, clients), AS_OF)


@register("detail_projection")
def q_detail_projection(spark, contracts, clients):
    return reports.detail_projection(datasets.lost_detail(contracts, clients, WINDOW))


@register("detail_table")
def q_detail_table(spark, contracts, clients):
    unsorted = datasets.lost_detail(contracts, clients, WINDOW, sort=False)
    return reports.detail_table(unsorted, AS_OF, N_MONTHS)
