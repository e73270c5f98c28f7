"""The whole report in one job plan: shared net losses, written once.

The dashboard needs D1 (by module), D2 (by plan), D3 (detail), D4 (active
base) and the frames built on them.  D1–D3 all start from the same net lost
lines; D2 only adds the add-on exclusion, which depends on the product alone
and therefore commutes with the latest-line rule and the renewal test.  So
the net lines are computed once *without* the exclusion, written to the
shared work folder as Parquet by month, and D3 is read from there.  D1 and D2
come from one pass over it, by grouping sets, written too (a few hundred rows).

The written copy replaces the source's one-hour result cache: each
``LossPage`` holds its own in ``folder``, which the caller deletes; rebuild the
page to refresh.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.functions import rules
from attrition.functions.dates import Window
from attrition.operators.net import net_lost
from attrition.plans import datasets, reports
from attrition.plans.ordering import order_bounded
from attrition.session import work_dir
from attrition.sources.sinks import write_dataset, write_months


def write_table(df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under ``folder`` and read from there.

    A lost executor re-reads files instead of recomputing the pipeline, and
    readers prune columns and, with ``by``, partitions.
    """
    path = write_dataset(df, f"{folder}/{name}", partition_by=by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@dataclass
class LossPage:
    contracts: DataFrame
    clients: DataFrame
    as_of: date
    n_months: int = 15
    window_months: int = 15
    materialize: bool = True
    _net: DataFrame | None = field(default=None, init=False, repr=False)
    _small: dict = field(default_factory=dict, init=False, repr=False)

    @cached_property
    def folder(self) -> str:
        """Where this page's written frames are."""
        return f"{work_dir(self.spark)}/attrition-page/{uuid.uuid4().hex}"

    @property
    def window(self) -> Window:
        return Window(self.as_of, self.window_months)

    @property
    def spark(self) -> SparkSession:
        return self.contracts.sparkSession

    def net(self) -> DataFrame:
        if self._net is None:
            net = net_lost(self.contracts, self.clients, self.window)
            self._net = write_table(net, self.folder, "net-lost", "month") if self.materialize else net
        return self._net

    def _shared(self, name: str, build) -> DataFrame:
        """A frame several report frames read: computed once (≤ 16 × 7 rows) and written."""
        if name not in self._small:
            df = build()
            self._small[name] = write_table(df, self.folder, name) if self.materialize else df
        return self._small[name]

    # datasets -------------------------------------------------------------
    def _grouped(self) -> DataFrame:
        return self._shared("grouped", lambda: datasets.lost_by_both(self.net()))

    def _by(self, name: str, exact: bool) -> DataFrame:
        amount = F.col("lost_amount") if exact else F.col("lost_amount").cast("double").alias("lost_amount")
        own = self._grouped().filter(F.col(name).isNotNull())
        return order_bounded(own.select("month", name, "lost_clients", amount), "month", name)

    def by_module(self, exact: bool = True) -> DataFrame:
        return self._by("module", exact)

    def by_plan(self, exact: bool = True) -> DataFrame:
        return self._by("plan", exact)

    def detail(self) -> DataFrame:
        return datasets.with_names(self.net(), self.clients)

    def active(self) -> DataFrame:
        return datasets.active_by_plan_month(self.contracts, self.window)

    # period-filtered frames, as the page shows them -------------------------
    def _period(self, df: DataFrame) -> DataFrame:
        return reports.last_n_months(df, self.as_of, self.n_months)

    def rate(self) -> DataFrame:
        return reports.loss_rate(self._period(self.active()), self._period(self.by_plan()))

    def frames(self) -> dict[str, DataFrame]:
        """Every report frame of the page, keyed like the registered queries."""
        mod, plan = self._period(self.by_module()), self._period(self.by_plan())
        rate = self._shared(
            "rate", lambda: reports.loss_rate(self._period(self.active()), plan)
        )
        totals = reports.monthly_totals(mod)
        amount = lambda df: df.withColumn("lost_amount", F.col("lost_amount").cast("double"))
        return {
            "kpi_summary": reports.kpi_summary(mod),
            "monthly_totals": amount(totals),
            "month_axis": reports.month_axis(mod),
            "series_module_amount": reports.series(
                reports.module_members(amount(mod)), "module", rules.MODULE_LABELS, "lost_amount"
            ),
            "series_module_clients": reports.series(
                reports.module_members(mod), "module", rules.MODULE_LABELS, "lost_clients"
            ),
            "series_plan_amount": reports.series(amount(plan), "plan", rules.PLAN_LABELS, "lost_amount"),
            "series_plan_clients": reports.series(plan, "plan", rules.PLAN_LABELS, "lost_clients"),
            "series_loss_pct": reports.series_loss_pct(rate),
            "base_vs_lost_latest": reports.base_vs_lost_latest(rate, self.as_of),
            "plan_strip": reports.plan_strip(self.spark, rate, self.as_of),
            "detail_table": reports.detail_table(
                datasets.with_names(self.net(), self.clients, sort=False), self.as_of, self.n_months
            ),
        }

    def write(self, path: str) -> dict[str, str]:
        """Write the four datasets (amounts as DOUBLE) under ``path``, partitioned by month.

        Only the window's months are replaced: earlier runs' older months stay.
        """
        double = lambda df: df.withColumn("lost_amount", F.col("lost_amount").cast("double"))
        out = {
            "lost_by_module_month": double(self.by_module()),
            "lost_by_plan_month": double(self.by_plan()),
            "lost_detail": datasets.sort_within_months(datasets.with_names(self.net(), self.clients, sort=False)),
            "active_by_plan_month": self.active(),
        }
        months = self.window.calendar()
        return {name: write_months(df, f"{path.rstrip('/')}/{name}", months) for name, df in out.items()}

    def write_frames(self, path: str) -> dict[str, str]:
        """Write every report frame (each at most a few hundred rows except the detail) under ``path``."""
        return {
            name: write_dataset(df, f"{path.rstrip('/')}/{name}", partition_by=None)
            for name, df in self.frames().items()
        }
