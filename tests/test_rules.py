"""The LIKE rule engine against DuckDB's LIKE on random product strings."""

from __future__ import annotations

import random
import unicodedata

import duckdb

import duck_oracle
from attrition.functions import rules

FRAGMENTS = [
    "[PRO]", "[pro]", "[PRO-RATA]", "[LITE]", "[STARTER]", "[FILHA]", "[BASIC]", "[KIDS]",
    "[JORNADA]", "[LOJAINTELIGENTE]", "[LOJAINTELIGENTE_INC]", "[LOJAINTELIGENTE-INC]",
    "[TOTEM]", "[VÍDEOS]", unicodedata.normalize("NFD", "[VÍDEOS]"), "[VIDEOS]", "[V DEOS]",
    "Módulo", "Modulo", "Setup", "SETUP", "0 - 9 Igrejas", "10+ Igrejas", "App Lite",
    "App da Igreja", "Squad as a Service", "Plano", " ", "x", "%", "_",
]


def test_classification_matches_duckdb_like(spark):
    rng = random.Random(5)
    products = [None] + ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(products)], "i int, product string")
    got = {
        r.i: (r.module, r.plan, r.recurring, r.base)
        for r in df.select(
            "i",
            rules.module_of("product").alias("module"),
            rules.plan_of("product").alias("plan"),
            rules.is_recurring("product").alias("recurring"),
            rules.is_base_plan_line("product").alias("base"),
        ).collect()
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INTEGER, product VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", list(enumerate(products)))
    expected = {
        i: (m, pl, rec, base)
        for i, m, pl, rec, base in con.execute(
            f"SELECT i, {duck_oracle.module_sql('product')}, {duck_oracle.plan_sql('product')}, "
            f"{duck_oracle.one_off_ok('product')}, {duck_oracle.base_plan_ok('product')} FROM p"
        ).fetchall()
    }
    assert got == expected
