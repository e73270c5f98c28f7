"""Hand rows: one small table per semantic trap, expected rows written out."""

from __future__ import annotations

import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from attrition.functions.dates import Window
from attrition.operators import active, ended
from attrition.operators import net as net_lines
from attrition.plans import datasets, reports
from helpers import D, client, contract, frames, rows

AS_OF = date(2001, 6, 15)
WIN = Window(AS_OF, 15)


def net(spark, contracts, clients=None, base_plan_only=False):
    c, k = frames(spark, contracts, clients)
    return net_lines.net_lost(c, k, WIN, base_plan_only)


def test_null_product_absent_everywhere(spark):  # T3
    cs = [contract(product=None, end_date=D(2001, 5, 10))]
    c, k = frames(spark, cs)
    assert datasets.lost_by_module_month(c, k, WIN).count() == 0
    assert datasets.lost_by_plan_month(c, k, WIN).count() == 0
    assert datasets.lost_detail(c, k, WIN).count() == 0
    assert datasets.active_by_plan_month(c, WIN).count() == 0


def test_null_client_adds_amount_not_clients(spark):  # T10
    cs = [contract(end_date=D(2001, 5, 10)), contract(client_id=None, end_date=D(2001, 5, 10))]
    c, k = frames(spark, cs)
    out = rows(datasets.lost_by_module_month(c, k, WIN))
    assert out == [(D(2001, 5, 1), "base", 1, 200.0)]


def test_null_start_not_active_no_error(spark):  # §4 note 4
    c, _ = frames(spark, [contract(start_date=None)])
    assert datasets.active_by_plan_month(c, WIN).count() == 0


def test_like_is_case_sensitive(spark):  # T2
    cs = [
        contract(product="[pro] Plano", end_date=D(2001, 5, 10)),
        contract(product="SETUP fee", end_date=D(2001, 5, 10)),
    ]
    out = rows(net(spark, cs), "product")
    assert out == [("SETUP fee",), ("[pro] Plano",)]
    c, k = frames(spark, cs)
    assert rows(datasets.lost_by_plan_month(c, k, WIN), "plan", "lost_amount") == [("outros", 200.0)]


def test_rule_order_combo_product(spark):  # T4
    cs = [contract(product="[PRO][KIDS] combo", end_date=D(2001, 5, 10))]
    c, k = frames(spark, cs)
    assert rows(datasets.lost_by_module_month(c, k, WIN), "module") == [("kids",)]
    assert rows(datasets.lost_detail(c, k, WIN), "module", "plan") == [("Kids", "PRO")]
    assert datasets.lost_by_plan_month(c, k, WIN).count() == 0


def test_pro_rata_is_not_pro(spark):  # T4
    from attrition.functions import rules

    df = spark.createDataFrame([("[PRO-RATA] x",), ("[PRO] x",)], "product string")
    got = rows(df.select("product", rules.plan_of("product").alias("plan")))
    assert got == [("[PRO-RATA] x", "outros"), ("[PRO] x", "pro")]


def test_underscore_wildcard_and_decomposed_accent(spark):  # T1
    composed = "[VÍDEOS] Acervo"
    decomposed = unicodedata.normalize("NFD", composed)
    assert composed != decomposed
    cs = [
        contract(product=composed, end_date=D(2001, 5, 10)),
        contract(product=decomposed, end_date=D(2001, 5, 10)),
        contract(product="[LOJAINTELIGENTE-INC] Loja", end_date=D(2001, 5, 10)),
    ]
    kept = rows(net(spark, cs, base_plan_only=True), "product")
    assert kept == [(decomposed,)]
    c, k = frames(spark, cs)
    assert rows(datasets.lost_by_module_month(c, k, WIN), "module") == [
        ("base",),
        ("loja_inteligente",),
    ]


def test_renewal_month_end_restarted_next_month(spark):  # J2
    cs = [contract(end_date=D(2001, 4, 30)), contract(start_date=D(2001, 5, 17))]
    assert net(spark, cs).count() == 0


def test_not_month_end_is_a_loss(spark):  # F5
    cs = [contract(end_date=D(2001, 4, 29)), contract(start_date=D(2001, 5, 1))]
    assert rows(net(spark, cs), "ended_on") == [(D(2001, 4, 29),)]


def test_restart_two_months_later_is_a_loss(spark):  # J2
    cs = [contract(end_date=D(2001, 4, 30)), contract(start_date=D(2001, 6, 1))]
    assert rows(net(spark, cs), "ended_on") == [(D(2001, 4, 30),)]


def test_renewal_key_removes_every_line_of_the_key(spark):  # T8
    cs = [
        contract(end_date=D(2001, 4, 30)),
        contract(end_date=D(2001, 4, 10), amount="50.00"),
        contract(start_date=D(2001, 5, 1)),
    ]
    assert net(spark, cs).count() == 0


def test_renewal_evidence_is_unfiltered(spark):  # T9: restart row may be a one-off/closed row
    cs = [
        contract(end_date=D(2001, 4, 30)),
        contract(start_date=D(2001, 5, 3), end_date=D(2001, 5, 4), amount=None),
    ]
    # The restart row itself ended 2001-05-04 (not month end) and is a loss.
    assert rows(net(spark, cs), "ended_on") == [(D(2001, 5, 4),)]


def test_client_cancel_date_wins(spark):  # P1
    cs = [contract(end_date=D(2000, 5, 31), cancel_date=D(2001, 5, 10))]
    assert rows(net(spark, cs), "ended_on", "month") == [(D(2001, 5, 10), D(2001, 5, 1))]


def test_open_line_latest_start_only(spark):  # W1, T19
    cs = [
        contract(start_date=D(2000, 1, 1)),
        contract(start_date=D(2000, 6, 1), amount="70.00"),
        contract(start_date=D(2000, 3, 1)),
    ]
    ks = [client(cancel_date=D(2001, 5, 10))]
    assert rows(net(spark, cs, ks), "ended_on", "amount") == [(D(2001, 5, 10), 70)]


def test_open_line_ties_broken_by_amount(spark):  # T11
    cs = [
        contract(start_date=D(2000, 6, 1), amount="70.00"),
        contract(start_date=D(2000, 6, 1), amount="90.00"),
        contract(start_date=None, amount="999.00"),
    ]
    ks = [client(cancel_date=D(2001, 5, 10))]
    assert [float(r[0]) for r in rows(net(spark, cs, ks), "amount")] == [90.0]


def test_duplicate_clients(spark):  # T20
    cs = [contract(start_date=D(2000, 1, 1)), contract(start_date=D(2000, 2, 1))]
    ks = [client(cancel_date=D(2001, 5, 10)), client(cancel_date=D(2001, 5, 10), client_name="Dup")]
    c, k = frames(spark, cs, ks)
    assert net_lines.net_lost(c, k, WIN).count() == 1
    assert datasets.lost_detail(c, k, WIN).count() == 2


@pytest.mark.parametrize(
    "end, inside",
    [(D(2000, 2, 29), False), (D(2000, 3, 1), True), (D(2001, 6, 30), True), (D(2001, 7, 1), False)],
)
def test_window_bounds(spark, end, inside):  # F2, T16
    assert (net(spark, [contract(end_date=end)]).count() == 1) is inside


@pytest.mark.parametrize(
    "start, end, expected",
    [
        (D(2001, 5, 1), None, True),
        (D(2001, 5, 2), None, False),
        (D(2000, 1, 1), D(2001, 5, 1), False),
        (D(2000, 1, 1), D(2001, 5, 2), True),
    ],
)
def test_active_half_open(spark, start, end, expected):  # F6
    c, _ = frames(spark, [contract(start_date=start, end_date=end)])
    months = {r["month"] for r in active.active_intervals(c, WIN).collect()}
    assert (D(2001, 5, 1) in months) is expected


def test_interval_inside_one_month(spark):  # §4 note 4: empty range, no sequence error
    c, _ = frames(spark, [contract(start_date=D(2001, 5, 10), end_date=D(2001, 5, 20))])
    assert active.active_intervals(c, WIN).count() == 0


def test_calendar_is_16_months(spark):  # S3
    from attrition.sources.calendar import month_calendar

    months = [r["month"] for r in month_calendar(spark, WIN).orderBy("month").collect()]
    assert months[0] == D(2000, 3, 1) and months[-1] == D(2001, 6, 1) and len(months) == 16


@pytest.mark.parametrize("as_of, n_expected", [(D(2001, 6, 15), 15), (D(2001, 6, 1), 16)])
def test_last_n_months_day_precision(spark, as_of, n_expected):  # T15
    from attrition.sources.calendar import month_calendar

    cal = month_calendar(spark, Window(as_of, 15))
    assert reports.last_n_months(cal, as_of, 15).count() == n_expected
    assert reports.last_n_months(cal, as_of, 0).count() == 16


def _totals(spark, rows_):
    return spark.createDataFrame(rows_, "month date, lost_amount decimal(28,2), lost_clients long")


def test_previous_is_previous_present_month(spark):  # T18
    from decimal import Decimal

    t = _totals(spark, [(D(2001, 6, 1), Decimal(10), 1), (D(2001, 4, 1), Decimal(30), 3)])
    r = reports.latest_previous(t).first()
    assert (r.last_month, float(r.prev_amount), r.delta_clients) == (D(2001, 6, 1), 30.0, -2)


def _rate(spark, rows_):
    return spark.createDataFrame(
        rows_, "month date, plan string, active_clients long, lost_clients long, loss_pct double"
    )


def test_latest_complete_falls_back_to_running_month(spark):  # A7
    r = _rate(spark, [(D(2001, 6, 1), "pro", 10, 1, 10.0)])
    assert reports.latest_complete_month(r, AS_OF).first().month == D(2001, 6, 1)


def test_loss_rate_left_from_base(spark):  # T22
    base = spark.createDataFrame(
        [(D(2001, 5, 1), "pro", 10)], "month date, plan string, active_clients long"
    )
    lost = spark.createDataFrame(
        [(D(2001, 5, 1), "lite", 3, 1.0)],
        "month date, plan string, lost_clients long, lost_amount double",
    )
    assert rows(reports.loss_rate(base, lost)) == [(D(2001, 5, 1), "pro", 10, 0, 0.0)]


def test_zero_base_gives_null_rate_and_dash(spark):  # T12
    cs = [contract(client_id=None, start_date=D(2000, 1, 1))]
    c, _ = frames(spark, cs)
    base = datasets.active_by_plan_month(c, WIN)
    assert {r.active_clients for r in base.collect()} == {0}
    lost = spark.createDataFrame([], "month date, plan string, lost_clients long, lost_amount double")
    rate = reports.loss_rate(base, lost)
    assert {r.loss_pct for r in rate.collect()} == {None}
    strip = {r.plan: r.loss_pct_text for r in reports.plan_strip(spark, rate, AS_OF).collect()}
    assert strip["pro"] == "—" and len(strip) == 7
    assert reports.series_loss_pct(rate).count() == 0  # A8: zero-base plan skipped


@pytest.mark.parametrize("lost, active_, pct", [(23, 160, 14.37), (1, 3, 33.33), (0, 5, 0.0)])
def test_rate_division_first_half_even(spark, lost, active_, pct):  # T13, T28
    df = spark.createDataFrame([(lost, active_)], "l long, a long")
    assert df.select(reports.loss_pct("l", "a").alias("p")).first().p == pct


def test_half_even_on_binary_value(spark):  # T13
    df = spark.createDataFrame([(1.015,)], "x double")
    assert df.select((F.rint(F.col("x") * 100) / 100).alias("r")).first().r == 1.01


def test_every_input_empty_gives_typed_empty(spark):  # F11
    c, k = frames(spark, [], [])
    for out in (
        datasets.lost_by_module_month(c, k, WIN),
        datasets.lost_by_plan_month(c, k, WIN),
        datasets.lost_detail(c, k, WIN),
        datasets.active_by_plan_month(c, WIN),
    ):
        assert out.count() == 0 and len(out.columns) >= 3
    kpi = reports.kpi_summary(datasets.lost_by_module_month(c, k, WIN, exact=True)).first()
    assert kpi.last_amount_text == "—" and kpi.period_amount_text == "R$ 0,00"
    assert kpi.delta_amount_text is None


def test_formats(spark):  # X15–X18
    from attrition.functions import formats

    df = spark.createDataFrame([(1234567.885, -1234.5, 12345, 14.37)], "a double, d double, n long, p double")
    r = df.select(
        formats.brl("a").alias("brl"),
        formats.brl("a", 0).alias("brl0"),
        formats.signed("d", 2, " R$").alias("sd"),
        formats.signed("n", 0).alias("sn"),
        formats.dotted_int("n").alias("dn"),
        formats.percent_1("p").alias("pc"),
        formats.month_label(F.lit(D(2026, 1, 1))).alias("ml"),
    ).first()
    assert (r.brl, r.brl0, r.sd, r.sn, r.dn, r.pc, r.ml) == (
        f"{1234567.885:,.2f}".translate(str.maketrans(",.", ".,")),
        "1.234.568",
        f"{-1234.5:+,.2f} R$",
        "+12,345",
        "12.345",
        "14.4%",
        "Jan/26",
    )


def test_last_n_months_lenient_text(spark):  # X11: bad text dropped, not raised
    from attrition.functions.dates import months_after_cutoff

    df = spark.createDataFrame([("2001-05-01",), ("not a date",), (None,), ("2000-01-01",)], "month string")
    out = df.filter(months_after_cutoff("month", AS_OF, 15, lenient=True))
    assert rows(out) == [("2001-05-01",)]


def test_excluded_addons_fall_into_base_module(spark):  # T5
    cs = [
        contract(product="[TOTEM] Quiosque", end_date=D(2001, 5, 10)),
        contract(product="[VIDEOS] Acervo", end_date=D(2001, 5, 10)),
        contract(product="[STARTER] Módulo extra", end_date=D(2001, 5, 10)),
    ]
    c, k = frames(spark, cs)
    assert rows(datasets.lost_by_module_month(c, k, WIN), "module", "lost_amount") == [("base", 300.0)]
    assert datasets.lost_by_plan_month(c, k, WIN).count() == 0
    assert rows(datasets.lost_detail(c, k, WIN), "module") == [("Base",)] * 3


def test_base_counts_in_totals_not_in_module_series(spark):  # T6, T7
    cs = [
        contract(product="[PRO] Plano", end_date=D(2001, 5, 10)),
        contract(product="[KIDS] Check-in", end_date=D(2001, 5, 12)),
    ]
    c, k = frames(spark, cs)
    d1 = datasets.lost_by_module_month(c, k, WIN, exact=True)
    tot = reports.monthly_totals(d1).first()
    assert (tot.lost_clients, float(tot.lost_amount)) == (2, 200.0)  # one client, counted per module
    assert rows(reports.module_members(d1), "module") == [("kids",)]


def test_base_ignores_one_offs_and_cancellations(spark):  # T21
    cs = [
        contract(product="Setup inicial", start_date=D(2000, 1, 1)),
        contract(client_id="c2", product="[PRO] Plano", start_date=D(2000, 1, 1)),
    ]
    ks = [client(), client("c2", "Two", cancel_date=D(2001, 5, 10))]
    c, k = frames(spark, cs, ks)
    active_may = {
        (r.plan, r.active_clients)
        for r in datasets.active_by_plan_month(c, WIN).collect()
        if r.month == D(2001, 6, 1)
    }
    assert active_may == {("outros", 1), ("pro", 1)}  # Setup line and cancelled client stay active
    assert rows(datasets.lost_by_plan_month(c, k, WIN), "plan") == [("pro",)]


def test_totals_of_null_amounts_are_zero(spark):  # T23
    from decimal import Decimal

    d1 = spark.createDataFrame(
        [(D(2001, 5, 1), "base", 1, None)], "month date, module string, lost_clients long, lost_amount decimal(28,2)"
    )
    assert reports.monthly_totals(d1).first().lost_amount == Decimal("0")
    assert reports.period_totals(d1).first().lost_amount == Decimal("0")


def test_zero_kpi_shows_dash(spark):  # T24
    from decimal import Decimal

    d1 = spark.createDataFrame(
        [(D(2001, 5, 1), "base", 0, Decimal("0.00"))],
        "month date, module string, lost_clients long, lost_amount decimal(28,2)",
    )
    kpi = reports.kpi_summary(d1).first()
    assert (kpi.last_amount_text, kpi.last_clients_text) == ("—", "—")
    assert kpi.period_amount_text == "R$ 0,00" and kpi.period_clients_text == "0"
