"""Hand-made rows for the cases the generated tables do not reach."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wagerlens.functions.columns import as_report
from wagerlens.model import CASH
from wagerlens.operators import acquisition as acq
from wagerlens.operators import financial as fin
from wagerlens.operators import funnel as fun
from wagerlens.operators import payments as pay
from wagerlens.operators import retention as ret
from wagerlens.operators import risk
from wagerlens.operators import trading as trd
from wagerlens.operators import vip
from wagerlens.operators import windows as win
from wagerlens.operators.players import first_deposits
from wagerlens.plans.catalog import REPORTS


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_empty_tables(tables, name):
    """No report fails on empty input; one-row reports still give their row."""
    df = as_report(REPORTS[name](tables()))
    found = df.collect()
    if name in {"fin_total_ggr", "trd_margin", "pay_cash_flow", "pay_amount_stats"}:
        assert len(found) == 2
    if name in {"acq_player_count", "fin_arpu", "ret_lifespan_stats", "trd_session_size", "pay_never_withdrew"}:
        assert len(found) == 1


def test_money_and_zero_stakes(tables, rows):
    t = tables(
        cash=[(1, "2020-01-05", 3, "0.00", "0.00"), (2, "2020-02-01", 1, "10.10", "20.25")],
        tourn=[(1, "2020-01-05", 1, "1.00001", "0.50000")],
    )
    assert rows(fin.fin_total_ggr(t)) == [
        (CASH, 10.10, 20.25, -10.15, -100.50),
        ("Tournaments", 1.00001, 0.5, 0.50001, 50.0),
    ]
    assert rows(fin.fin_monthly_ggr(t), "month", "ggr", "hold_pct") == [
        (dt.date(2020, 1, 1), 0.0, None),
        (dt.date(2020, 2, 1), -10.15, -100.50),
    ]
    assert rows(fin.fin_total_handle(t)) == [(11.10001, 10.10, 1.00001)]


def test_unknown_age_country_and_gender(tables, rows):
    t = tables(players=[(1, None, None, None), (2, 20, "M", 40), (3, 55, "F", 40), (4, 56, "M", 276)])
    assert rows(acq.acq_by_country(t)) == [(40, 2, 50.0), (276, 1, 25.0)]
    assert rows(acq.acq_gender(t)) == [("M", 2, 50.0), ("F", 1, 25.0)]
    assert rows(acq.acq_age_distribution(t)) == [
        ("Under 21", 1, 25.0),
        ("46-55", 1, 25.0),
        ("55+", 1, 25.0),
        ("Unknown", 1, 25.0),
    ]


def test_depositors_without_a_player_row_count(tables, rows):
    t = tables(players=[(1, 30, "M", 40)], deposits=[(1, "2020-01-01", 10, "S"), (9, "2020-01-01", 10, "S")])
    assert rows(acq.acq_ftd_conversion(t)) == [(1, 2, 200.0)]
    assert rows(fun.fun_full(t), "stage", "count")[:2] == [("Signed Up", 1), ("Made Deposit", 1)]
    assert rows(fun.fun_dropoff(t), "from_count", "to_count", "dropped")[0] == (1, 2, -1)


def test_first_deposit_takes_time_then_id(tables, rows):
    t = tables(
        deposits=[
            (1, "2020-01-01 10:00:00", 99, "F", "Cards", 1),
            (1, "2020-01-01 12:00:00", 30, "S", "eWallet", 5),
            (1, "2020-01-01 12:00:00", 20, "S", "ewallet", 4),
            (2, "2020-03-01 09:00:00", 50, "S", "eWallet", 7),
        ]
    )
    assert rows(acq.acq_first_deposit_stats(t)) == [(2, 35.0, 35.0, 20.0, 50.0)]
    assert rows(acq.acq_first_deposit_by_method(t)) == [("eWallet", 1, 50.0), ("ewallet", 1, 50.0)]
    assert rows(win.win_first_record(t), "user_id", "deposit_id", "deposit_sequence") == [(1, 4, 1), (2, 7, 1)]
    assert rows(win.win_first_last_deposit(t), "first_deposit_amount", "last_deposit_amount") == [(20.0, 30.0), (50.0, 50.0)]


def test_lifespan_and_cohorts(tables, rows):
    days = [(1, "2020-01-10"), (1, "2020-02-09"), (2, "2020-01-31"), (3, "2020-02-01"), (3, "2020-04-30")]
    t = tables(
        cash=[(u, d, 1, 1, 1) for u, d in days], tourn=[(2, "2020-02-29", 1, 1, 1), (2, "2020-01-31", 1, 1, 1)]
    )
    assert rows(ret.ret_cohort(t)) == [(dt.date(2020, 1, 1), 2, 2, 100.0), (dt.date(2020, 2, 1), 1, 0, 0.0)]
    assert rows(ret.ret_cohort(t, months=2), "month_2_retained") == [(0,), (1,)]
    assert rows(ret.ret_buckets(t)) == [("8-30 days", 2, 66.67), ("1-3 months", 1, 33.33)]
    assert rows(ret.ret_session_gaps(t)) == [(49.3, 30.0, 29, 89)]
    assert rows(ret.ret_mau(t))[0] == (dt.date(2020, 1, 1), 2)
    assert rows(ret.ret_mau(t, games=("Tournaments",))) == [(dt.date(2020, 1, 1), 1), (dt.date(2020, 2, 1), 1)]
    assert rows(ret.ret_inactive_90d(t)) == []
    assert rows(ret.ret_inactive_90d(t, days=61)) == [(1, dt.date(2020, 2, 9), 81, "At High Risk")]


def test_vip_inactivity_bands(tables, rows):
    """Five equal depositors are all VIP; one has never played."""
    last = {1: "2020-12-31", 2: "2020-11-30", 3: "2020-10-31", 4: "2020-06-01", 6: "2021-01-01"}
    t = tables(
        deposits=[(u, "2020-01-01", 100, "S") for u in (1, 2, 3, 4, 5)],
        cash=[(u, d, 1, 5, 5) for u, d in last.items() if u % 2],
        tourn=[(u, d, 1, 5, 5) for u, d in last.items() if u % 2 == 0],
    )
    assert rows(vip.vip_at_risk(t), "user_id", "days_inactive", "status") == [
        (1, 1, "Active"),
        (2, 32, "At Risk"),
        (3, 62, "At High Risk"),
        (4, 214, "Churned"),
        (5, None, "Active"),
    ]


def test_vip_versus_regular_counts_all_stakes(tables, rows):
    t = tables(
        deposits=[(1, "2020-01-01", 900, "S"), (2, "2020-01-01", 10, "S"), (3, "2020-01-01", 10, "S")],
        cash=[(1, "2020-01-01", 1, 50, 0), (2, "2020-01-01", 1, 30, 0), (8, "2020-01-01", 1, 20, 0)],
    )
    assert sorted(rows(vip.vip_vs_regular(t, p=0.9))) == [("Regular", 2, 30.0, 30.0, 30.0), ("VIP", 1, 50.0, 50.0, 50.0)]


def test_play_before_deposit_is_in_the_last_band(tables, rows):
    t = tables(
        deposits=[(u, "2020-01-10", 10, "S") for u in (1, 2, 3)],
        cash=[(1, "2020-01-08", 1, 1, 1), (2, "2020-01-10", 1, 1, 1), (3, "2020-01-11", 1, 1, 1)],
    )
    assert rows(fun.fun_time_to_first_play(t)) == [
        ("30+ Days", 1, 33.33),
        ("Same Day", 1, 33.33),
        ("Next Day", 1, 33.33),
    ]
    assert rows(fun.fun_time_to_first_play(t, split_negative=True), "time_to_first_play")[0] == ("Before Deposit",)


def test_repeat_play_is_within_one_game(tables, rows):
    """One day in each game is not a repeat; two days in one game are."""
    t = tables(
        players=[(1, 30, "M", 1), (2, 30, "M", 1)],
        cash=[(1, "2020-01-01", 1, 1, 1), (2, "2020-01-01", 1, 1, 1), (2, "2020-01-02", 1, 1, 1)],
        tourn=[(1, "2020-01-05", 1, 1, 1)],
    )
    assert rows(fun.fun_full(t), "stage", "count")[2:4] == [("Made First Play", 2), ("Made Repeat Play", 1)]


def test_profit_statuses(tables, rows):
    t = tables(
        cash=[(1, "2020-01-01", 1, 10, 10), (2, "2020-01-01", 1, 10, 30), (3, "2020-01-01", 1, 10, 12)],
        tourn=[(3, "2020-01-01", 1, 9, 0), (4, "2020-01-01", 1, 1, 50)],
    )
    assert rows(trd.trd_pnl_distribution(t)) == [
        ("Break Even", 1, 33.33),
        ("Losing", 1, 33.33),
        ("Profitable", 1, 33.33),
    ]
    assert rows(trd.trd_pnl_distribution(t, games=(CASH,), break_even=False)) == [
        ("Profitable", 2, 66.67),
        ("Losing", 1, 33.33),
    ]
    assert rows(trd.trd_game_preference(t)) == [
        ("Cash Games Only", 2),
        ("Tournaments Only", 1),
        ("Both (Hybrid)", 1),
    ]


def test_age_bands_leave_out_the_oldest_and_unknown(tables, rows):
    t = tables(
        players=[(1, None, "M", 1), (2, 24, "M", 1), (3, 54, "M", 1), (4, 60, "M", 1)],
        deposits=[(u, "2020-01-01", 10, "S") for u in (1, 2, 4)],
        cash=[(2, "2020-01-01", 1, 10, 4), (1, "2020-01-01", 1, 5, 1)],
    )
    assert rows(fun.fun_by_age(t)) == [("Under 25", 1, 1, 1, 100.0, 100.0), ("45-54", 1, 0, 0, 0.0, None)]
    assert rows(trd.trd_pnl_by_age(t)) == [("Under 25", 1, -6.0, -6.0)]


def test_risk_limits_are_strict(tables, rows):
    """Half of the deposits failing, or a ratio of exactly 0.5, does not raise a flag."""
    half = [(1, "2020-01-01", 10, s) for s in "FFFSSS"]
    most = [(2, "2020-01-01", 10, s) for s in "FFFSS"]
    t = tables(
        players=[(1, 30, "M", 1), (2, 30, "M", 1), (3, 30, "M", 1)],
        deposits=half + most + [(3, "2020-01-05", 100, "S"), (4, "2020-01-05", 100, "S")],
        withdrawals=[(2, "2020-01-03", 5, "S"), (3, "2020-01-06", 5, "S"), (4, "2020-01-01", 5, "S")],
        cash=[(3, "2020-01-05", 1, "49.99", 0), (4, "2020-01-05", 1, 50, 0)],
    )
    assert rows(risk.risk_high_deposit_failure(t)) == [(2, 5, 2, 3, 60.0)]
    assert rows(risk.risk_low_play(t)) == [(3, 100.0, 49.99, 49.99)]
    assert rows(risk.risk_quick_withdrawal(t), "user_id", "days_to_withdraw") == [(4, -4), (3, 1)]
    assert rows(risk.risk_composite_score(t)) == [(3, 0, 0, 1, 1, 2)]
    assert rows(risk.risk_flags_by_country(t, min_players=3)) == [(1, 3, 2, 66.67)]
    assert rows(risk.risk_flags_by_country(t)) == []


def test_amount_on_a_limit_takes_the_lower_band(tables, rows):
    amounts = ["9.99", "10.00", "20.00", "20.01", "50.00", "100.00", "500.00", "1000.00", "1000.01"]
    t = tables(deposits=[(1, "2020-01-01", a, "S") for a in amounts])
    assert rows(pay.pay_amount_buckets(t), "deposit_bucket", "count") == [
        ("< €10", 1),
        ("€10-20", 2),
        ("€20-50", 2),
        ("€50-100", 1),
        ("€100-500", 1),
        ("€500-1000", 1),
        ("€1000+", 1),
    ]


def test_month_with_failures_only_shows_zero(tables, rows):
    t = tables(deposits=[(1, "2020-01-01", 10, "F"), (1, "2020-02-01", 10, "S")])
    assert rows(pay.pay_monthly_trend(t)) == [
        ("Deposits", dt.date(2020, 1, 1), 0.0, 0),
        ("Deposits", dt.date(2020, 2, 1), 10.0, 1),
    ]
    assert rows(pay.pay_peak_hours(t)) == [(0, 2, 10.0)]
    assert rows(pay.pay_peak_weekdays(t)) == [(3, "Wednesday", 1, 0.0), (6, "Saturday", 1, 10.0)]


def test_peers_share_the_running_total(tables, rows):
    at = "2020-01-01 10:00:00"
    t = tables(
        deposits=[
            (1, at, 10, "S"),
            (1, at, 20, "S"),
            (1, "2020-01-01 10:30:00", 5, "S"),
            (1, "2020-01-02 00:00:00", 1, "S"),
            (2, at, 7, "S"),
        ]
    )
    running = rows(win.win_running_total(t, players=None), "user_id", "amount", "running_total", "deposit_number")
    assert sorted(running) == [
        (1, 1.0, 36.0, 4),
        (1, 5.0, 35.0, 3),
        (1, 10.0, 30.0, 2),
        (1, 20.0, 30.0, 2),
        (2, 7.0, 7.0, 1),
    ]
    assert rows(win.win_running_total(t, min_deposits=2, players=1), "user_id") == [(1,)] * 4
    daily = rows(win.win_running_total(t, players=None, by_day=True), "user_id", "running_total", "deposit_number")
    assert sorted(daily) == [(1, 35.0, 3)] * 3 + [(1, 36.0, 4), (2, 7.0, 1)]


def test_gap_lists(tables, rows):
    days = ["01", "01", "03", "10"]
    t = tables(deposits=[(1, "2020-01-05", 1, "S")] + [(2, f"2020-01-{d}", 1, "S") for d in days])
    assert rows(win.win_days_since_prev(t), "user_id", "days_since_prev") == [(2, 0), (2, 2), (2, 7)]
    assert rows(win.win_days_since_prev(t, n=2), "days_since_prev") == [(0,), (2,)]
    assert rows(win.win_days_since_prev(t, direction="next"), "days_to_next") == [(0,), (2,), (7,)]
    assert rows(win.win_avg_gap(t, min_gaps=3)) == [(2, 3, 3.0, 0, 7)]


def test_ties_in_rankings(tables, rows):
    totals = {1: 50, 2: 80, 3: 80, 4: 20, 5: 50, 6: 10}
    t = tables(
        players=[(u, 30, "M", 40 + u % 2) for u in totals], deposits=[(u, "2020-01-01", a, "S") for u, a in totals.items()]
    )
    assert rows(win.win_rank_deposits(t)) == [
        (2, 80.0, 1, 1, 1),
        (3, 80.0, 1, 1, 2),
        (1, 50.0, 3, 2, 3),
        (5, 50.0, 3, 2, 4),
        (4, 20.0, 5, 3, 5),
        (6, 10.0, 6, 4, 6),
    ]
    # the third listed player is tied with one beyond the list, and shares the running total
    assert rows(win.win_pct_of_total(t, n=3), "user_id", "running_total", "cumulative_pct") == [
        (2, 160.0, 55.17),
        (3, 160.0, 55.17),
        (1, 260.0, 89.66),
    ]
    assert rows(win.win_rank_in_country(t), "country_id", "user_id", "rank_in_country") == [
        (40, 2, 1),
        (40, 4, 2),
        (40, 6, 3),
        (41, 3, 1),
        (41, 1, 2),
        (41, 5, 2),
    ]
    assert rows(vip.vip_top_depositors(t, n=3), "user_id", "deposit_rank") == [(2, 1), (3, 1), (1, 3)]


@pytest.mark.parametrize("people", [1, 9, 10, 11, 23, 40])
def test_decile_equals_ntile(tables, rows, spark, people):
    t = tables(deposits=[(u, "2020-01-01", 1000 - u, "S") for u in range(people)])
    spark.createDataFrame([(u,) for u in range(people)], "u long").createOrReplaceTempView("people")
    want = [tuple(r) for r in spark.sql("SELECT u, ntile(10) OVER (ORDER BY u) FROM people ORDER BY u").collect()]
    assert rows(win.win_rank_deposits(t, n=50), "user_id", "decile") == want


def _unknowns(tables, spark):
    """A player with a deposit without a time, one without a day, and days with one side unknown."""
    t = tables(
        players=[(1, 30, "M", 1), (2, 40, "F", 1), (3, 50, "M", 1)],
        cash=[(1, "2020-01-01", 1, "100.50", "90.25"), (1, "2020-01-02", 1, 50, None), (3, "2020-01-01", 1, 10, 12)],
        deposits=[(1, "2020-02-01 10:00:00", 10, "S"), (1, "2020-02-02 10:00:00", 20, "S"), (1, "2020-02-03 09:00:00", 30, "S"), (1, "2020-02-04 09:00:00", 40, "S")],
    )
    second, fourth = F.col("deposit_id") == 2, F.col("deposit_id") == 4
    t.deposits = t.deposits.withColumn("process_ts", F.when(~second & ~fourth, F.col("process_ts"))).withColumn(
        "process_date", F.when(~fourth, F.col("process_date"))
    )
    return t


def test_unknown_moments_come_last_and_lose_no_row(tables, spark, rows):
    t = _unknowns(tables, spark)
    for by_day in (False, True):
        found = rows(win.win_running_total(t, players=None, by_day=by_day), "amount", "running_total", "deposit_number")
        assert sorted(found) == [(10.0, 10.0, 1), (20.0, 30.0, 2), (30.0, 60.0, 3), (40.0, 100.0, 4)]
    assert rows(first_deposits(t.deposits), "deposit_id") == [(1,)]
    assert rows(win.win_first_last_deposit(t), "first_deposit_amount", "last_deposit_amount") == [(10.0, 40.0)]
    assert [r[-1] for r in rows(win.win_days_since_prev(t))] == [1, 1]


def test_one_unknown_side_does_not_take_the_other_away(tables, spark, rows):
    t = _unknowns(tables, spark)
    assert rows(fin.fin_total_ggr(t), "ggr")[0] == (58.25,)
    assert rows(fin.fin_arpu(t), "total_players", "total_ggr") == [(2, 58.25)]
    assert sorted(rows(trd.trd_pnl_distribution(t), "player_status", "player_count")) == [("Losing", 1), ("Profitable", 1)]
    unknown = tables(cash=[(2, "2020-01-01", 1, 50, None)])
    assert rows(trd.trd_pnl_distribution(unknown), "player_status", "player_count") == [("Break Even", 1)]
