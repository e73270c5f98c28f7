"""Driver-side date helpers (window bounds) agree with Spark's date functions."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from attrition.functions.dates import Window, first_of_month, last_of_month, shift_months


def test_helpers_match_spark_functions(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(2000):
        d = date(1996, 1, 1) + timedelta(days=rng.randrange(365 * 12))
        if rng.random() < 0.3:  # month ends, including Feb 29, exercise clamping
            d = last_of_month(d)
        cases.append((d, rng.randrange(-40, 41)))
    df = spark.createDataFrame(cases, "d date, n int")
    got = df.select(
        "d", "n",
        F.expr("add_months(d, n)").alias("shifted"),
        F.trunc("d", "MM").alias("first"),
        F.last_day("d").alias("last"),
    ).collect()
    for r in got:
        assert shift_months(r.d, r.n) == r.shifted, (r.d, r.n)
        assert first_of_month(r.d) == r.first
        assert last_of_month(r.d) == r.last


def test_window_bounds():
    w = Window(date(2001, 6, 15), 15)
    assert (w.lo, w.month0, w.hi) == (date(2000, 3, 1), date(2001, 6, 1), date(2001, 6, 30))
    leap = Window(date(2000, 2, 10), 1)
    assert (leap.lo, leap.hi) == (date(2000, 1, 1), date(2000, 2, 29))
