"""Differential test: every registered query against its DuckDB oracle (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from attrition.plans import catalog
from compare import compare, duck_connect

SMALL = "/root/testdata/sf0.001"
KEYS = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SMALL)


def test_every_key_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(spark, con, key, SMALL, E.queries()[key], E.oracle_sql()[key])
    assert r["cols_match"], r
    assert r["match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "module", "lost_clients", "lost_amount"]
    assert df.count() == 59  # FIXTURES §3, sf0.001


def test_all_keys_without_aqe_or_broadcast(spark, con):
    """Same results with AQE off, 3 shuffle partitions and no automatic broadcast."""
    off = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "3",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        bad = [
            key
            for key in KEYS
            if not compare(spark, con, key, SMALL, E.queries()[key], E.oracle_sql()[key]).get("match")
        ]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert not bad, bad
