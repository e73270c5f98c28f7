"""Promises of the whole library: lazy operators, exact amounts, row order, typed empty frames."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attrition.plans import catalog, datasets
from attrition.sources import fixtures
from attrition.sources.tables import scan_contracts
from helpers import client, contract, frames

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return fixtures.derive(spark, SMALL)


@pytest.mark.parametrize("key", sorted(catalog.OPERATORS))
def test_no_job_before_the_action(spark, small, key):
    spark.sparkContext.setJobGroup(f"build-{key}", key)
    try:
        catalog.OPERATORS[key](spark, *small)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{key}")


def test_parts_of_a_cent_are_summed(spark, tmp_path):
    c, k = frames(spark, [contract(client_id=f"c{i}", end_date=date(2001, 5, 3), amount="0.004") for i in range(1000)], [client()])
    c.withColumn("amount", F.col("amount").cast("decimal(20,12)")).write.parquet(str(tmp_path / "c"))
    back = scan_contracts(spark, str(tmp_path / "c"))
    assert back.schema["amount"].dataType.scale == 12
    assert datasets.lost_by_module_month(back, k, catalog.WINDOW).first().lost_amount == 4.0
    assert back.agg(F.sum("amount")).first()[0] == Decimal("4")


def _down(rows):
    return sorted(rows, key=lambda r: (r.month, r.lost_amount is not None, r.lost_amount or 0), reverse=True)


@pytest.mark.parametrize("key", ["lost_by_module_month", "lost_by_plan_month", "active_by_plan_month", "lost_by_module_month_sql"])
def test_grouped_datasets_are_in_order(spark, small, key):
    rows = catalog.OPERATORS[key](spark, *small).collect()
    assert len(rows) > 10 and rows == sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("key", ["lost_detail", "detail_projection", "detail_table"])
def test_detail_is_in_order(spark, small, key):
    rows = catalog.OPERATORS[key](spark, *small).collect()
    keys = [(r.month, r.lost_amount) for r in rows]
    assert len(keys) > 100 and keys == [(r.month, r.lost_amount) for r in _down(rows)]


def test_empty_period_keeps_its_types(spark, small):
    full, empty = (catalog.OPERATORS[k](spark, *small) for k in ("kpi_summary", "kpi_summary_empty"))
    assert full.dtypes == empty.dtypes
    row = empty.first()
    assert row.last_month is None and row.period_amount == 0 and row.last_amount_text == "—"


def test_grouped_losses_read_the_contracts_twice(spark, small, tmp_path):
    small[0].write.parquet(str(tmp_path / "contracts"))
    c = scan_contracts(spark, str(tmp_path / "contracts"))
    for key in ("lost_by_module_month", "lost_by_plan_month", "lost_by_module_month_sql"):
        plan = catalog.OPERATORS[key](spark, c, small[1])._jdf.queryExecution().optimizedPlan().toString()
        # the contracts twice (tagged lines; open lines) and the clients once
        assert plan.count("Relation [") <= 3 and "LeftAnti" not in plan, plan
