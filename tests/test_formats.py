"""Display formats against Python's own formatting (what the source used)."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attrition.functions import formats


def _brl(v: float, d: int) -> str:
    whole, _, cents = f"{abs(v):.{d}f}".partition(".")
    groups = []
    while whole:
        whole, last = whole[:-3], whole[-3:]
        groups.insert(0, last)
    minus = "-" if f"{v:.{d}f}".startswith("-") else ""
    return minus + ".".join(groups) + ("," + cents if cents else "")


def test_formats_match_python(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, -0.001, -0.004, 0.125, 0.375, 2.675, 1.005, 1234.5, -1234.5, 999999.995, 1e9 + 0.5]
    values += [round(rng.uniform(-1e7, 1e7), rng.choice([0, 1, 2, 3])) for _ in range(3000)]
    ints = [0, 7, -7, 999, 1000, -12345, 10**9] + [rng.randrange(-10**7, 10**7) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(
        "v",
        formats.brl("v", 2).alias("b2"),
        formats.brl("v", 0).alias("b0"),
        formats.signed("v", 2, " R$").alias("s2"),
        formats.percent_1("v").alias("p1"),
    ).collect()
    for r in got:
        assert r.b2 == _brl(r.v, 2), r.v
        assert r.b0 == _brl(r.v, 0), r.v
        assert r.s2 == f"{r.v:+,.2f} R$", r.v
        assert r.p1 == f"{r.v:.1f}%", r.v
    dfi = spark.createDataFrame([(n,) for n in ints], "n long")
    for r in dfi.select("n", formats.dotted_int("n").alias("d"), formats.signed("n", 0).alias("s")).collect():
        assert r.d == f"{r.n:,}".replace(",", "."), r.n
        assert r.s == f"{r.n:+,.0f}", r.n


def test_month_labels_match_python(spark):
    from datetime import date

    months = [date(y, m, 1) for y in (1999, 2000, 2001, 2026) for m in range(1, 13)]
    df = spark.createDataFrame([(d,) for d in months], "d date")
    for r in df.select("d", formats.month_label("d").alias("label")).collect():
        assert r.label == r.d.strftime("%b/%y").capitalize(), r.d
