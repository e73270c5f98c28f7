"""Properties over the derived test data (sf0.001) and measured counts (sf0.01)."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from attrition.functions import rules
from attrition.functions.dates import Window
from attrition.operators import active, ended
from attrition.operators import net as net_lines
from attrition.plans import catalog, datasets, reports
from attrition.sources import fixtures
from helpers import rows

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
WIN = Window(date(2001, 6, 15), 15)


@pytest.fixture(scope="module")
def small(spark):
    return fixtures.derive(spark, SMALL)


def test_ended_is_net_plus_removed(spark, small):
    c, k = small
    d0 = ended.ended_contracts(c, k, WIN)
    keys = ended.renewal_keys(d0, c, WIN)
    removed = d0.join(keys, ended.KEY, "left_semi")
    net = ended.drop_renewed(d0, keys)
    assert d0.count() == net.count() + removed.count()
    assert removed.count() == 19 and keys.count() == 18  # FIXTURES §3, sf0.001


def test_exclusion_commutes_with_renewal_step(spark, small):
    c, k = small
    early = net_lines.net_lost(c, k, WIN, base_plan_only=True)
    late = net_lines.net_lost(c, k, WIN).filter(rules.is_base_plan_line("product"))
    assert rows(early) == rows(late)


def test_module_sums_equal_monthly_totals(spark, small):
    c, k = small
    d1 = datasets.lost_by_module_month(c, k, WIN, exact=True)
    tot = reports.monthly_totals(d1)
    by_month = d1.groupBy("month").agg(F.sum("lost_amount").alias("a"), F.sum("lost_clients").alias("n"))
    assert rows(tot, "month", "lost_amount", "lost_clients") == rows(by_month, "month", "a", "n")


def test_detail_sums_equal_module_sums(spark, small):
    c, k = small
    d1 = datasets.lost_by_module_month(c, k, WIN, exact=True)
    d3 = datasets.lost_detail(c, k, WIN)
    a = d1.groupBy("month").agg(F.sum("lost_amount").cast("double").alias("x"))
    b = d3.groupBy("month").agg(F.sum(F.col("lost_amount").cast("decimal(28,2)")).cast("double").alias("x"))
    assert rows(a) == rows(b)


def test_explode_equals_cross_join(spark, small):
    from attrition.functions.dates import active_at
    from attrition.sources.calendar import month_calendar

    c, _ = small
    exploded = active.active_intervals(c, WIN, keep=["client_id", "product", "start_date", "end_date"])
    cal = month_calendar(spark, WIN)
    crossed = (
        F.broadcast(cal)
        .join(c, active_at(c.start_date, c.end_date, cal.month))
        .select("month", "client_id", "product", "start_date", "end_date")
    )
    assert rows(exploded) == rows(crossed)


def test_independent_of_partitioning(spark, small):
    c, k = small
    base = rows(datasets.lost_by_module_month(c, k, WIN))
    c2 = c.repartition(7, F.rand(seed=3))
    k2 = k.repartition(3)
    assert rows(datasets.lost_by_module_month(c2, k2, WIN)) == base
    assert rows(ended.latest_open_cancelled(c2, k2, WIN)) == rows(ended.latest_open_cancelled(c, k, WIN))


@pytest.mark.parametrize("day", [1, 28])
def test_as_of_within_month(spark, small, day):
    c, k = small
    ref = rows(datasets.lost_by_plan_month(c, k, WIN))
    moved = Window(date(2001, 6, day), 15)
    assert rows(datasets.lost_by_plan_month(c, k, moved)) == ref
    assert rows(datasets.active_by_plan_month(c, WIN)) == rows(datasets.active_by_plan_month(c, moved))


def test_measured_counts_sf001(spark):
    c, k = fixtures.derive(spark, MID)
    assert (c.count(), c.filter("end_date is not null").count(), c.filter("cancel_date is not null").count()) == (
        60000,
        29936,
        5046,
    )
    d1 = catalog.QUERIES["lost_by_module_month"](spark, MID)
    agg = d1.agg(F.count("*"), F.sum("lost_clients"), F.sum(F.col("lost_amount").cast("decimal(20,2)"))).first()
    assert (agg[0], agg[1], float(agg[2])) == (64, 5993, 530461577.59)
    d2 = catalog.QUERIES["lost_by_plan_month"](spark, MID)
    agg = d2.agg(F.count("*"), F.sum("lost_clients"), F.sum(F.col("lost_amount").cast("decimal(20,2)"))).first()
    assert (agg[0], agg[1], float(agg[2])) == (112, 4327, 320725512.48)
    d4 = catalog.QUERIES["active_by_plan_month"](spark, MID)
    assert d4.agg(F.count("*"), F.sum("active_clients")).first()[:] == (112, 52190)
    assert catalog.QUERIES["lost_detail"](spark, MID).count() == 9993
    assert catalog.QUERIES["detail_table"](spark, MID).count() == 9350
    # Over all 16 months (FIXTURES §3) and over the 15-month period the page shows.
    full = reports.loss_rate(datasets.active_by_plan_month(c, WIN), datasets.lost_by_plan_month(c, k, WIN))
    assert full.agg(F.min("loss_pct"), F.max("loss_pct")).first()[:] == (3.04, 13.74)
    rate = catalog.QUERIES["loss_rate"](spark, MID).agg(F.min("loss_pct"), F.max("loss_pct")).first()
    assert rate[:] == (3.04, 12.73)
    tot = {r.month: (r.lost_clients, r.lost_amount) for r in catalog.QUERIES["monthly_totals"](spark, MID).collect()}
    assert tot[date(2001, 6, 1)] == (389, 30816625.55)
    assert tot[date(2001, 5, 1)] == (412, 40084292.79)


def test_page_frames_equal_registered_queries(spark, small):
    from attrition.plans.page import LossPage

    c, k = small
    page = LossPage(c, k, date(2001, 6, 15))
    frames = page.frames()
    for key, df in frames.items():
        expected = catalog.QUERIES[key](spark, SMALL)
        assert sorted(df.columns) == sorted(expected.columns), key
        assert rows(df, *sorted(df.columns)) == rows(expected, *sorted(df.columns)), key


def test_page_write_round_trip(spark, small, tmp_path):
    from attrition.plans.page import LossPage

    c, k = small
    paths = LossPage(c, k, date(2001, 6, 15)).write(str(tmp_path / "out"))
    back = spark.read.parquet(paths["lost_by_module_month"])
    expected = catalog.QUERIES["lost_by_module_month"](spark, SMALL)
    cols = sorted(expected.columns)
    assert rows(back.select(*cols)) == rows(expected.select(*cols))


def test_work_dir_reads_session_setting(spark):
    from attrition.session import work_dir

    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert work_dir(spark) == configured.rstrip("/")


def test_batch_entry_point(spark, small, tmp_path):
    from attrition.__main__ import main

    c, k = small
    c.write.parquet(str(tmp_path / "contracts"))
    k.write.parquet(str(tmp_path / "clients"))
    paths = main([
        "--contracts", str(tmp_path / "contracts"),
        "--clients", str(tmp_path / "clients"),
        "--out", str(tmp_path / "report"),
        "--as-of", "2001-06-15",
        "--frames",
    ])
    datasets_written = {"lost_by_module_month", "lost_by_plan_month", "lost_detail", "active_by_plan_month"}
    assert datasets_written < set(paths) and "plan_strip" in paths
    strip = spark.read.parquet(paths["plan_strip"])
    assert rows(strip, "plan", "loss_pct_text") == rows(
        catalog.QUERIES["plan_strip"](spark, SMALL), "plan", "loss_pct_text"
    )
    back = spark.read.parquet(paths["active_by_plan_month"])
    expected = catalog.QUERIES["active_by_plan_month"](spark, SMALL)
    cols = sorted(expected.columns)
    assert rows(back.select(*cols)) == rows(expected.select(*cols))


@pytest.mark.parametrize("months", [15, 40, 59, 60, 62, 63, 200])
def test_active_mask_path_equals_explode_count(spark, small, months):
    from attrition.operators.active import active_counts, active_intervals

    c, _ = small
    base = c.select("client_id", "start_date", "end_date", rules.plan_of("product").alias("plan"))
    w = Window(date(2001, 6, 15), months)
    fast = active_counts(base, w, group="plan")
    plain = (
        active_intervals(base, w, keep=["client_id", "plan"])
        .groupBy("month", "plan")
        .agg(F.count_distinct("client_id").alias("active"))
    )
    assert rows(fast) == rows(plain)


@pytest.mark.parametrize("months", [0, 3, 70])
def test_window_length_only_selects_months(spark, small, months):
    """With unique clients, a month's losses do not depend on the window length."""
    c, k = small
    w15, w = Window(date(2001, 6, 15), 15), Window(date(2001, 6, 15), months)
    lo = max(w15.lo, w.lo)
    for build in (datasets.lost_by_module_month, datasets.lost_by_plan_month):
        a = build(c, k, w15).filter(F.col("month") >= F.lit(lo))
        b = build(c, k, w).filter(F.col("month") >= F.lit(lo))
        assert rows(a) == rows(b)
    a = datasets.active_by_plan_month(c, w15).filter(F.col("month") >= F.lit(lo))
    b = datasets.active_by_plan_month(c, w).filter(F.col("month") >= F.lit(lo))
    assert rows(a) == rows(b)


def test_scan_from_catalog_table(spark, small):
    from attrition.sources.tables import CONTRACTS_SCHEMA, scan_contracts

    c, _ = small
    c.createOrReplaceTempView("contracts_view_for_test")
    back = scan_contracts(spark, "contracts_view_for_test", fmt="table")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in CONTRACTS_SCHEMA]
    assert rows(back) == rows(c)
