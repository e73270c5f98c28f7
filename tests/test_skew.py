"""Skew: one (client, product) holds a third of all contract lines.

Results must equal the DuckDB oracle on the same files, and the plans must
pre-aggregate the hot key before any shuffle (partial aggregates in the
physical plan) rather than shipping the whole group to one task.
"""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import duck_oracle
from attrition.operators import ended
from attrition.plans import catalog
from attrition.sources.fixtures import PRODUCTS
from attrition.sources.tables import CLIENTS_SCHEMA, CONTRACTS_SCHEMA, conform
from compare import rows_of

N = 300_000


def _h(seed: int):
    return F.abs(F.xxhash64(F.col("id"), F.lit(seed)))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("skew")
    hot = F.col("id") % 3 == 0
    day = lambda origin, span, seed: F.date_add(F.lit(origin).cast("date"), (_h(seed) % span).cast("int"))
    end = day("1999-12-01", 670, 4)
    contracts = spark.range(N).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("c"), (_h(1) % 5000).cast("string"))).alias("client_id"),
        F.when(hot, F.lit("[PRO] Plano"))
        .otherwise(F.element_at(F.array(*[F.lit(p) for p in PRODUCTS]), (_h(2) % 20 + 1).cast("int")))
        .alias("product"),
        day("1999-06-01", 820, 3).alias("start_date"),
        F.when(_h(5) % 10 < 4, F.lit(None).cast("date"))
        .when(_h(6) % 2 == 0, F.last_day(end))
        .otherwise(end)
        .alias("end_date"),
        F.when(_h(7) % 20 == 0, day("2000-01-01", 640, 8)).alias("cancel_date"),
        ((_h(9) % 100000) / 100).cast("decimal(18,2)").alias("amount"),
    )
    clients = spark.range(5001).select(
        F.when(F.col("id") == 5000, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("client_id"),
        F.concat(F.lit("Client "), F.col("id").cast("string")).alias("client_name"),
        F.when((F.col("id") % 4 == 0) | (F.col("id") == 5000), day("2000-03-01", 480, 10)).alias("cancel_date"),
    )
    conform(contracts, CONTRACTS_SCHEMA).write.parquet(str(base / "contracts"))
    conform(clients, CLIENTS_SCHEMA).write.parquet(str(base / "clients"))
    return str(base / "contracts"), str(base / "clients")


def _explain(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize(
    "key", ["lost_by_module_month", "lost_by_plan_month", "active_by_plan_month", "lost_detail", "plan_strip"]
)
def test_skewed_results_match_oracle(spark, skewed, key):
    import duckdb

    cpath, kpath = skewed
    c, k = spark.read.parquet(cpath), spark.read.parquet(kpath)
    sdf = catalog.OPERATORS[key](spark, c, k)
    s_rows = [tuple(r) for r in sdf.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW contracts_in AS SELECT * FROM read_parquet('{cpath}/*.parquet')")
    con.execute(f"CREATE VIEW clients_in AS SELECT * FROM read_parquet('{kpath}/*.parquet')")
    res = con.execute(duck_oracle.oracle_texts_on_inputs()[key])
    d_cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(d_cols)
    assert rows_of(s_rows, sdf.columns) == rows_of(res.fetchall(), d_cols)
    assert len(s_rows) > 0


def test_hot_key_is_pre_aggregated(spark, skewed):
    cpath, kpath = skewed
    c, k = spark.read.parquet(cpath), spark.read.parquet(kpath)
    w = catalog.WINDOW
    latest = _explain(ended.latest_open_cancelled(c, k, w))
    assert "partial_max" in latest  # one row per key per map task before the shuffle
    keys = _explain(ended.renewal_keys(ended.ended_contracts(c, k, w), c, w))
    assert keys.count("HashAggregate") >= 4  # both distinct key sets partially aggregated
    active = _explain(catalog.OPERATORS["active_by_plan_month"](spark, c, k))
    assert "partial_bit_or" in active and "Generate" in active


def test_skewed_detail_without_broadcast(spark, skewed):
    """No broadcast at all (ours or Spark's): every join is a sort-merge join."""
    import duckdb

    cpath, kpath = skewed
    c, k = spark.read.parquet(cpath), spark.read.parquet(kpath)
    off = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        sdf = catalog.OPERATORS["lost_detail"](spark, c, k)
        s_rows = [tuple(r) for r in sdf.collect()]
        assert "BroadcastHashJoin" not in _explain(sdf)
    finally:
        for key in off:
            spark.conf.unset(key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW contracts_in AS SELECT * FROM read_parquet('{cpath}/*.parquet')")
    con.execute(f"CREATE VIEW clients_in AS SELECT * FROM read_parquet('{kpath}/*.parquet')")
    res = con.execute(duck_oracle.oracle_texts_on_inputs()["lost_detail"])
    d_cols = [d[0] for d in res.description]
    assert rows_of(s_rows, sdf.columns) == rows_of(res.fetchall(), d_cols)


def test_detail_sort_spreads_exact_copies(spark):
    """A third of the detail rows are exact copies: the sort must not put them in one task."""
    from attrition.plans.datasets import sort_detail

    n = 30_000
    copy = F.col("id") % 3 == 0
    detail = spark.range(n).select(
        F.lit("2001-05-01").cast("date").alias("month"),
        F.lit("Base").alias("module"),
        F.lit("PRO").alias("plan"),
        F.when(copy, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("client_id"),
        F.lit("Client").alias("client_name"),
        F.lit("[PRO] Plano").alias("product"),
        F.when(copy, F.lit(100.0)).otherwise((F.col("id") % 997).cast("double")).alias("lost_amount"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = sort_detail(detail.repartition(8))
        sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
        first = ordered.first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n
    assert max(sizes) < n / 3  # the 10,000 copies are split over several partitions
    assert first.lost_amount == 996.0  # order still by amount descending
