"""Every report by name, by segment, with the parameters it runs with.

A report maps the five tables to one DataFrame. Variants of an operator are
entries of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from wagerlens.model import CASH, Tables
from wagerlens.operators import acquisition as acq
from wagerlens.operators import financial as fin
from wagerlens.operators import funnel as fun
from wagerlens.operators import payments as pay
from wagerlens.operators import retention as ret
from wagerlens.operators import risk
from wagerlens.operators import trading as trd
from wagerlens.operators import vip
from wagerlens.operators import windows as win
from wagerlens.sources import checks

Report = Callable[[Tables], DataFrame]


def _named(*functions: Report) -> dict[str, Report]:
    return {function.__name__: function for function in functions}


SEGMENTS: dict[str, dict[str, Report]] = {
    "00_checks": _named(checks.verify_row_counts, checks.check_keys, checks.check_domains),
    "01_financial_performance": _named(
        fin.fin_total_ggr,
        fin.fin_total_handle,
        fin.fin_hold_by_game,
        fin.fin_monthly_ggr,
        fin.fin_arpu,
        fin.fin_net_revenue_proxy,
    ),
    "02_player_acquisition": _named(
        acq.acq_player_count,
        acq.acq_by_country,
        acq.acq_age_distribution,
        acq.acq_gender,
        acq.acq_ftd_conversion,
        acq.acq_first_deposit_stats,
        acq.acq_first_deposit_by_method,
    ),
    "03_retention_churn": _named(
        ret.ret_activity_window,
        ret.ret_lifespan_stats,
        ret.ret_buckets,
        ret.ret_mau,
        ret.ret_churn_buckets,
        ret.ret_inactive_90d,
        ret.ret_session_gaps,
        ret.ret_cohort,
    )
    | {"ret_mau_cash": partial(ret.ret_mau, games=(CASH,))},
    "04_vip_analysis": _named(
        vip.vip_top_depositors,
        vip.vip_concentration,
        vip.vip_identify,
        vip.vip_profile,
        vip.vip_vs_regular,
        vip.vip_at_risk,
        vip.vip_clv,
    )
    | {"vip_concentration_two_segments": partial(vip.vip_concentration, segments=vip.TOP_AND_OTHER)},
    "05_fraud_risk": _named(
        risk.risk_deposit_failure_by_method,
        risk.risk_high_deposit_failure,
        risk.risk_reversal_by_method,
        risk.risk_high_reversal,
        risk.risk_quick_withdrawal,
        risk.risk_low_play,
        risk.risk_high_win_rate,
        risk.risk_composite_score,
        risk.risk_flags_by_country,
    )
    | {
        "risk_score_three_flags": partial(risk.risk_composite_score, flags=risk.THREE_FLAGS),
        "risk_score_listed_flags": partial(risk.risk_composite_score, flags=risk.LISTED_FLAGS),
    },
    "06_payments": _named(
        pay.pay_deposit_success,
        pay.pay_withdrawal_success,
        pay.pay_cash_flow,
        pay.pay_net_to_platform,
        pay.pay_amount_stats,
        pay.pay_time_to_first_withdrawal,
        pay.pay_never_withdrew,
        pay.pay_monthly_trend,
        pay.pay_peak_hours,
        pay.pay_peak_weekdays,
        pay.pay_amount_buckets,
    ),
    "07_trading_performance": _named(
        trd.trd_margin,
        trd.trd_monthly_margin,
        trd.trd_pnl_distribution,
        trd.trd_top_winners,
        trd.trd_top_losers,
        trd.trd_pnl_by_age,
        trd.trd_revenue_by_country,
        trd.trd_game_preference,
        trd.trd_session_size,
        trd.trd_peak_weekdays,
    )
    | {"trd_pnl_cash_only": partial(trd.trd_pnl_distribution, games=(CASH,), break_even=False)},
    "08_funnel_analysis": _named(
        fun.fun_full,
        fun.fun_by_country,
        fun.fun_by_age,
        fun.fun_by_first_method,
        fun.fun_time_to_first_play,
        fun.fun_to_vip,
        fun.fun_dropoff,
    ),
    "09_window_functions": _named(
        win.win_rank_deposits,
        win.win_rank_in_country,
        win.win_running_total,
        win.win_days_since_prev,
        win.win_avg_gap,
        win.win_mom_deposits,
        win.win_mom_ggr,
        win.win_cumulative_deposits,
        win.win_first_last_deposit,
        win.win_moving_avg_ggr,
        win.win_pct_of_total,
        win.win_first_record,
    )
    | {
        "win_running_total_all": partial(win.win_running_total, players=None),
        "win_running_total_by_day": partial(win.win_running_total, players=None, by_day=True),
        "win_days_to_next": partial(win.win_days_since_prev, direction="next"),
    },
}

REPORTS: dict[str, Report] = {name: report for group in SEGMENTS.values() for name, report in group.items()}
