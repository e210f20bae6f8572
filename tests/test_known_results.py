"""Results that are known from published figures: inputs of one report rebuilt from another."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wagerlens.functions.columns import pct, quotient
from wagerlens.operators import financial as fin
from wagerlens.operators import payments as pay
from wagerlens.operators import risk
from wagerlens.operators import vip
from wagerlens.operators import windows as win

MONTHS = ["2015-02", "2015-03", "2015-04", "2015-05", "2015-06"]
STAKES = ["2387715.32", "3113136.46", "2082135.48", "1288362.19", "1992531.27"]
WINNINGS = ["2228359.72", "2992499.69", "2050979.44", "1264690.32", "1998125.39"]
DEPOSITS = ["583747.55", "500701.36", "312897.70", "229714.97", "161010.70"]


def test_monthly_revenue_and_what_follows_from_it(tables, rows):
    t = tables(cash=[(1, f"{m}-15", 1, s, w) for m, s, w in zip(MONTHS, STAKES, WINNINGS)])
    assert rows(fin.fin_monthly_ggr(t), "ggr", "hold_pct") == [
        (159355.60, 6.67),
        (120636.77, 3.88),
        (31156.04, 1.50),
        (23671.87, 1.84),
        (-5594.12, -0.28),
    ]
    assert rows(win.win_mom_ggr(t), "mom_change", "mom_change_pct") == [
        (None, None),
        (-38718.83, -24.30),
        (-89480.73, -74.17),
        (-7484.17, -24.02),
        (-29265.99, -123.63),
    ]
    assert [r[0] for r in rows(win.win_moving_avg_ggr(t), "moving_avg_3m")] == [
        159355.60,
        139996.19,
        103716.14,
        58488.23,
        16411.26,
    ]


def test_monthly_deposits_and_what_follows_from_them(tables, rows):
    t = tables(deposits=[(1, f"{m}-15", a, "S") for m, a in zip(MONTHS, DEPOSITS)])
    assert rows(win.win_mom_deposits(t), "mom_change", "mom_change_pct") == [
        (None, None),
        (-83046.19, -14.23),
        (-187803.66, -37.51),
        (-83182.73, -26.58),
        (-68704.27, -29.91),
    ]
    assert [r[0] for r in rows(win.win_cumulative_deposits(t), "cumulative_deposits")] == [
        583747.55,
        1084448.91,
        1397346.61,
        1627061.58,
        1788072.28,
    ]


def test_segment_sizes_of_5006_depositors(tables, rows):
    t = tables(deposits=[(u, "2015-02-01", 1 + u % 700, "S") for u in range(5006)])
    assert rows(vip.vip_concentration(t), "segment", "player_count") == [
        ("Top 5%", 251),
        ("Top 6-20%", 753),
        ("Top 21-50%", 1502),
        ("Bottom 50%", 2500),
    ]


def test_shares_of_the_top_depositors(tables, rows):
    top = {59212: "237773.06", 35834: "177897.25", 30147: "144328.00", 61454: "137685.00", 16895: "120279.64"}
    rest = Decimal("9685194.34") - sum(Decimal(a) for a in top.values())
    small = [(u, "2015-02-01", rest / 1000 // Decimal("0.01") * Decimal("0.01"), "S") for u in range(1, 1001)]
    small.append((1, "2015-02-02", rest - 1000 * small[0][2], "S"))
    t = tables(deposits=[(u, "2015-02-01", a, "S") for u, a in top.items()] + small)
    assert rows(win.win_pct_of_total(t, n=5)) == [
        (59212, 237773.06, 2.4550, 237773.06, 2.46),
        (35834, 177897.25, 1.8368, 415670.31, 4.29),
        (30147, 144328.00, 1.4902, 559998.31, 5.78),
        (61454, 137685.00, 1.4216, 697683.31, 7.20),
        (16895, 120279.64, 1.2419, 817962.95, 8.45),
    ]


def test_failure_rates(tables, rows):
    counts = {"Mobile Carrier Billing": (8, 102), "Others": (0, 3), "Prepaid Cards": (247, 71), "ewallet": (378, 103)}
    t = tables(
        deposits=[
            (1, "2015-02-01", 1, status, method)
            for method, (ok, failed) in counts.items()
            for status in "S" * ok + "F" * failed
        ]
    )
    assert rows(risk.risk_deposit_failure_by_method(t), "pay_method_cat", "failure_rate_pct") == [
        ("Others", 100.0),
        ("Mobile Carrier Billing", 92.73),
        ("Prepaid Cards", 22.33),
        ("ewallet", 21.41),
    ]
    assert rows(pay.pay_deposit_success(t), "pay_method_cat", "successful") == [
        ("ewallet", 378),
        ("Prepaid Cards", 247),
        ("Mobile Carrier Billing", 8),
        ("Others", 0),
    ]


def test_rounding_of_published_ratios(spark):
    cases = [
        (pct, "681252.51", "29105646.91", 2, 2.34),
        (pct, "410849.96968", "3662849.04697", 2, 11.22),
        (quotient, "681252.51", "4232", 2, 160.98),
        (pct, "5272426.09", "9685194.34", 2, 54.44),
        (pct, "3267", "5006", 2, 65.26),
        (pct, "-22", "5006", 2, -0.44),
        (quotient, "279992.37", "2", 2, 139996.19),
        (quotient, "-0.25", "10", 2, -0.03),
        (pct, "1", "0", 2, None),
    ]
    for function, n, d, places, want in cases:
        row = spark.range(1).select(function(F.lit(Decimal(n)), F.lit(Decimal(d)), places).alias("r")).first()
        assert (None if row.r is None else float(row.r)) == want


def test_days_inactive_at_the_end_of_the_data(tables, rows):
    t = tables(
        deposits=[(u, "2015-02-01", 100, "S") for u in (59212, 35834)],
        cash=[(59212, "2020-04-26", 1, 1, 1), (35834, "2016-03-01", 1, 1, 1), (5, "2021-01-01", 1, 1, 1)],
    )
    assert rows(vip.vip_at_risk(t), "user_id", "last_play", "days_inactive", "status") == [
        (35834, dt.date(2016, 3, 1), 1767, "Churned"),
        (59212, dt.date(2020, 4, 26), 250, "Churned"),
    ]
