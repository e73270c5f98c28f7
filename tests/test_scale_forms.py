"""Fused masks, pushed bounds on timestamps, copies in two levels, months replaced one by one, order shown."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import duck_oracle
from attrition.functions.dates import Window, stored
from attrition.operators import ended, key_masks, net
from attrition.plans import catalog, datasets, reports
from attrition.plans.page import LossPage
from attrition.sources import fixtures
from attrition.sources.sinks import write_months
from attrition.sources.tables import scan_clients, scan_contracts
from compare import rows_of
from helpers import client, contract, frames, rows
from test_fuzz import generate

SMALL = "/root/testdata/sf0.001"
D = date


@pytest.fixture(scope="module")
def small(spark):
    return fixtures.derive(spark, SMALL)


@pytest.fixture(scope="module")
def stored_small(spark, small, tmp_path_factory):
    """The small inputs as files with DATE columns, and again with TIMESTAMP columns."""
    folder = tmp_path_factory.mktemp("stored")
    out = {}
    for kind in ("date", "timestamp", "timestamp_ntz"):
        for name, df in zip(("contracts", "clients"), small, strict=True):
            days = [c for c, t in df.dtypes if t == "date"]
            part_of_day = F.make_dt_interval(hours=F.lit(13), mins=F.lit(5))
            df = df.withColumns({c: F.col(c).cast(kind) + part_of_day if kind != "date" else F.col(c) for c in days})
            df.coalesce(1).write.parquet(f"{folder}/{kind}/{name}")
        out[kind] = scan_contracts(spark, f"{folder}/{kind}/contracts"), scan_clients(spark, f"{folder}/{kind}/clients")
    return out


def executed(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# -- one pass for the base and the losses -----------------------------------------


@pytest.mark.parametrize(("seed", "months"), [(1, 15), (2, 0), (3, 60), (4, 130)])
def test_fused_counts_equal_the_datasets(spark, seed, months):
    from attrition.sources.tables import CLIENTS_SCHEMA, CONTRACTS_SCHEMA

    contracts, clients = generate(seed)
    c, k = spark.createDataFrame(contracts, CONTRACTS_SCHEMA), spark.createDataFrame(clients, CLIENTS_SCHEMA)
    w = Window(D(2001, 6, 15), months)
    two = reports.loss_rate(datasets.active_by_plan_month(c, w), datasets.lost_by_plan_month(c, k, w))
    one = reports.with_rate(key_masks.base_and_lost(c, k, w))
    assert one.dtypes == two.dtypes and rows(one) == rows(two)
    lines = ended.ended_contracts(c, k, w)
    plain = ended.drop_renewed(lines, ended.renewal_keys(lines, c, w))
    assert rows(net.net_lost(c, k, w), *plain.columns) == rows(plain)


def test_masks_of_single_lines(spark):
    w = Window(D(2001, 6, 15), 15)
    bit = lambda y, m: 1 << ((y - 2000) * 12 + m - 3)
    c, k = frames(
        spark,
        [
            contract("a", "x", D(2001, 1, 10), D(2001, 3, 31)),
            contract("a", "x", D(2001, 4, 2), D(2001, 4, 20)),
            contract("b", "x", D(2001, 1, 1), None),
            contract("b", "x", D(2001, 2, 1), None),
            contract(None, "x", D(2001, 4, 1), D(2001, 3, 31)),
            contract("c", "x", None, None),
            contract("d", "x", D(1999, 1, 1), D(1999, 12, 31)),
        ],
        [client("b", cancel_date=D(2001, 5, 31)), client("b", cancel_date=D(2001, 4, 1)), client("c", cancel_date=D(1999, 1, 1))],
    )
    got = {r.client_id: r for r in key_masks.key_masks(c, k, w).withColumn("lost", key_masks.lost(0)).collect()}
    a, b, none = got["a"], got["b"], got[None]
    assert a.active_0 == bit(2001, 2) | bit(2001, 3) and a.restart_0 == bit(2000, 12) | bit(2001, 3)
    assert a.ended_0 == bit(2001, 3) | bit(2001, 4) and a.month_end_0 == bit(2001, 3) and a.lost == bit(2001, 4)
    assert b.ended_0 == b.month_end_0 == b.lost == bit(2001, 5) and b.active_0 == sum(bit(2001, m) for m in range(1, 7))
    assert none.month_end_0 == none.restart_0 == none.lost == bit(2001, 3)  # a NULL key is never renewed
    assert (got["c"].active_0, got["c"].ended_0) == (0, 0) and "d" not in got


@pytest.mark.parametrize(("key", "most"), [("loss_rate", 1), ("plan_strip", 1), ("series_loss_pct", 1), ("lost_detail", 3), ("detail_table", 3), ("drop_renewed", 3)])
def test_scans_of_the_contracts(spark, stored_small, key, most):
    c, k = stored_small["date"]
    plan = catalog.OPERATORS[key](spark, c, k)._jdf.queryExecution().optimizedPlan().toString()
    reads = [x for x in re.findall(r"Relation \[([^\]]*)\]", plan) if "start_date" in x]
    assert 1 <= len(reads) <= most, plan


@pytest.mark.parametrize("key", ["drop_renewed", "lost_detail", "loss_rate"])
def test_without_broadcasts(spark, small, key):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    con = __import__("compare").duck_connect(SMALL)
    want = con.execute(duck_oracle.oracle_texts()[key])
    columns = [d[0] for d in want.description]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        df = catalog.OPERATORS[key](spark, *small)
        assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), columns)
    finally:
        for name in names:
            spark.conf.unset(name)


@pytest.mark.parametrize("key", ["kpi_summary", "latest_previous", "plan_strip", "base_vs_lost_latest"])
def test_no_window_over_one_partition(spark, small, key):
    assert "Window" not in executed(catalog.OPERATORS[key](spark, *small))


# -- dates stored as timestamps ------------------------------------------------------


def pushed(df) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", executed(df))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_bounds_reach_a_timestamp_scan(spark, stored_small, kind):
    c, k = stored_small[kind]
    assert stored("end_date") in c.columns and c.schema["end_date"].dataType.typeName() == "date"
    (closed,) = pushed(ended.closed_ended(c, catalog.WINDOW))
    assert "GreaterThanOrEqual(cancel_date,2000-03-01" in closed and "LessThan(end_date,2001-07-01" in closed, closed
    (base,) = pushed(datasets.active_by_plan_month(c, catalog.WINDOW))
    assert "LessThan(start_date,2001-06-02" in base and "GreaterThanOrEqual(end_date,2000-03-02" in base, base
    assert any("GreaterThanOrEqual(start_date,2000-04-01" in p for p in pushed(ended.restarted_keys(c, catalog.WINDOW)))
    assert any("LessThan(cancel_date,2001-07-01" in p for p in pushed(ended.open_cancelled(c, k, catalog.WINDOW)))


@pytest.mark.parametrize(("kind", "zone"), [("timestamp", "America/Sao_Paulo"), ("timestamp_ntz", "UTC")])
def test_timestamps_give_what_dates_give(spark, stored_small, kind, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        c, k = stored_small[kind]
        # the same instants as dates, without the stored form
        plain = [df.select(*[x for x in df.columns if "__" not in x]) for df in (c, k)]
        for key in ("loss_rate", "drop_renewed", "active_intervals"):
            assert rows(catalog.OPERATORS[key](spark, c, k)) == rows(catalog.OPERATORS[key](spark, *plain)), key
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# -- copies ------------------------------------------------------------------------


def test_copies_are_numbered(spark):
    counted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", 10), ("e", 1000)], "x string, _copies long")
    got = datasets.numbered_copies(counted, ["x"]).select("x", "_copy").collect()
    assert sorted(got) == sorted((x, i) for x, n in counted.collect() for i in range(n))


def test_millions_of_copies_are_spread(spark):
    """No row holds a number for each of its copies, and no task makes them all."""
    n = 5_000_000
    one = spark.range(n, numPartitions=8).select(
        F.lit(D(2001, 5, 1)).alias("month"), F.lit("Base").alias("module"), F.lit("PRO").alias("plan"), F.lit("c").alias("client_id"),
        F.lit("n").alias("client_name"), F.lit("p").alias("product"), F.lit(1.5).alias("lost_amount"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in datasets.sort_detail(one).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) < n / 4
    blocks = datasets.numbered_copies(spark.createDataFrame([("a", 10**14)], "x string, _copies long"), ["x"])
    assert re.search(r"Arguments: hashpartitioning\(x#\d+, _block#", executed(blocks))


# -- sink and page --------------------------------------------------------------------


def test_months_before_the_window_stay(spark, small, tmp_path):
    c, k = small
    out = str(tmp_path / "report")
    first = LossPage(c, k, D(2001, 2, 10), window_months=4).write(out)
    old = {name: rows(spark.read.parquet(path)) for name, path in first.items()}
    second = LossPage(c, k, D(2001, 6, 15), window_months=4).write(out)
    fresh = LossPage(c, k, D(2001, 6, 15), window_months=4).write(str(tmp_path / "alone"))
    lo = D(2001, 2, 1)
    for name, path in second.items():
        back = spark.read.parquet(path)
        at = back.columns.index("month")
        assert [r for r in rows(back) if r[at] >= lo] == rows(spark.read.parquet(fresh[name]))
        assert [r for r in rows(back) if r[at] < lo] == [r for r in old[name] if r[at] < lo] != []


def test_months_without_rows_are_taken_off(spark, tmp_path):
    path = str(tmp_path / "t")
    month = lambda *ms: spark.createDataFrame([(D(2001, m, 1), m) for m in ms], "month date, x int")
    write_months(month(1, 2, 3, 4), path, [D(2001, m, 1) for m in range(1, 5)])
    write_months(month(3, 9), path, [D(2001, m, 1) for m in (2, 3)])
    assert rows(spark.read.parquet(path), "month", "x") == [(D(2001, m, 1), m) for m in (1, 3, 4)]
    write_months(month().filter("x > 0"), path, [D(2001, 3, 1)])
    assert rows(spark.read.parquet(path), "x") == [(1,), (4,)]


def test_grouping_sets_equal_the_datasets(spark, small):
    c, k = small
    w = catalog.WINDOW
    both = datasets.lost_by_both(net.net_lost(c, k, w))
    for name, build in (("module", datasets.lost_by_module_month), ("plan", datasets.lost_by_plan_month)):
        own = both.filter(F.col(name).isNotNull()).select("month", name, "lost_clients", F.col("lost_amount").cast("double"))
        assert rows(own) == rows(build(c, k, w))
    null = frames(spark, [contract(product=None, end_date=D(2001, 5, 3))])
    assert datasets.lost_by_both(net.net_lost(*null, w)).count() == 0


# -- order -----------------------------------------------------------------------------

ORDERED = [
    "lost_by_module_month", "lost_by_plan_month", "active_by_plan_month", "lost_detail", "detail_projection", "detail_table",
    "month_axis", "monthly_totals", "series_module_amount", "series_module_clients", "series_plan_amount", "series_plan_clients",
    "series_plan_amount_wide", "series_loss_pct", "loss_rate", "base_vs_lost_latest", "plan_strip",
]


@pytest.mark.parametrize("key", ORDERED)
def test_rows_come_in_the_oracle_s_order(spark, small, key):
    """Row by row, by the columns of the oracle's ORDER BY, on shuffled input."""
    from compare import in_order

    c, k = small
    df = catalog.OPERATORS[key](spark, c.repartition(7, "amount"), k)
    assert in_order([r.asDict() for r in df.collect()], duck_oracle.order_of(key))
