"""Segment 5: fraud and risk signals.

Rate rules compare products (``100 * failed > rate * attempts``) instead of
quotients, so no rounding decides whether a player is flagged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wagerlens.functions.columns import count_if, number, pct
from wagerlens.model import FAILED, REVERSED, SUCCESS, Tables
from wagerlens.operators.players import (
    cash_profit,
    cash_measures,
    cash_results,
    deposit_measures,
    depositor_totals,
    per_player,
    signups,
    withdrawal_measures,
)


def _status_rate(df: DataFrame, by: str, total: str, lost: str, lost_status: str, rate: str) -> DataFrame:
    """Attempts, successes and losses per ``by``, and losses as a percentage of attempts."""
    return (
        df.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias(total),
            count_if(F.col("status") == SUCCESS).alias("successful"),
            count_if(F.col("status") == lost_status).alias(lost),
        )
        .withColumn(rate, pct(F.col(lost), F.col(total)))
    )


def _often(lost: str, total: str, min_attempts: int, rate: float) -> Column:
    return (F.col(total) >= min_attempts) & (F.col(lost) * 100 > F.col(total) * number(rate))


def risk_deposit_failure_by_method(t: Tables) -> DataFrame:
    rates = _status_rate(t.deposits, "pay_method_cat", "total_attempts", "failed", FAILED, "failure_rate_pct")
    return rates.orderBy(F.desc("failure_rate_pct"), "pay_method_cat")


def risk_high_deposit_failure(t: Tables, min_attempts: int = 5, rate: float = 50) -> DataFrame:
    rates = _status_rate(t.deposits, "user_id", "total_deposits", "failed", FAILED, "failure_rate")
    return rates.filter(_often("failed", "total_deposits", min_attempts, rate)).orderBy(
        F.desc("failure_rate"), "user_id"
    )


def risk_reversal_by_method(t: Tables) -> DataFrame:
    rates = _status_rate(t.withdrawals, "pay_method_cat", "total_attempts", "reversed", REVERSED, "reversal_rate_pct")
    return rates.orderBy(F.desc("reversal_rate_pct"), "pay_method_cat")


def risk_high_reversal(t: Tables, min_attempts: int = 3, rate: float = 70) -> DataFrame:
    rates = _status_rate(t.withdrawals, "user_id", "total_withdrawals", "reversed", REVERSED, "reversal_rate")
    return rates.filter(_often("reversed", "total_withdrawals", min_attempts, rate)).orderBy(
        F.desc("reversal_rate"), "user_id"
    )


def _days_to_withdraw() -> Column:
    return F.datediff("first_withdrawal_date", "first_deposit_date")


def risk_quick_withdrawal(t: Tables, days: int = 1) -> DataFrame:
    """First withdrawal at most ``days`` after the first deposit, or before it."""
    return (
        per_player(deposit_measures(t), withdrawal_measures(t))
        .select(
            "user_id",
            "first_deposit_date",
            "first_withdrawal_date",
            _days_to_withdraw().alias("days_to_withdraw"),
        )
        .filter(F.col("days_to_withdraw") <= days)
        .orderBy("days_to_withdraw", "user_id")
    )


def _staked() -> Column:
    return F.coalesce(F.col("cash_stakes"), F.lit(0).cast("decimal(22,2)"))


def _low_play(min_deposited: float, ratio: float) -> Column:
    deposited = F.col("total_deposited")
    return (deposited >= number(min_deposited)) & (_staked() < deposited * number(ratio))


def risk_low_play(t: Tables, min_deposited: float = 100, ratio: float = 0.5) -> DataFrame:
    """Deposited ``min_deposited`` or more, but staked less than ``ratio`` of it in cash games."""
    return (
        depositor_totals(t)
        .join(per_player(cash_measures(t)), "user_id", "left")
        .filter(_low_play(min_deposited, ratio))
        .select(
            "user_id",
            "total_deposited",
            _staked().alias("total_stakes"),
            pct(_staked(), F.col("total_deposited")).alias("play_ratio_pct"),
        )
        .orderBy(F.desc("total_deposited"), "user_id")
    )


def _wins_too_much(profit: Column, stakes: Column, min_stakes: float, roi: float) -> Column:
    return (stakes > number(min_stakes)) & (stakes > 0) & (profit * 100 > stakes * number(roi))


def risk_high_win_rate(t: Tables, min_stakes: float = 100, roi: float = 20, n: int = 50) -> DataFrame:
    profit, stakes = F.col("net_profit"), F.col("total_stakes")
    return (
        cash_results(t)
        .filter(_wins_too_much(profit, stakes, min_stakes, roi))
        .select(
            "user_id",
            "total_stakes",
            "total_winnings",
            "net_profit",
            "play_days",
            pct(profit, stakes).alias("return_pct"),
        )
        .orderBy(F.desc("return_pct"), "user_id")
        .limit(n)
    )


def _flag_rules() -> dict[str, Column]:
    return {
        "deposit_failure_flag": _often("deposits_failed", "deposit_attempts", 5, 50),
        "withdrawal_reversal_flag": _often("withdrawals_reversed", "withdrawal_attempts", 3, 70),
        "quick_withdrawal_flag": _days_to_withdraw() <= 1,
        "low_play_flag": _low_play(100, 0.5),
        "high_win_rate_flag": _wins_too_much(cash_profit(), F.col("cash_stakes"), 100, 20),
    }


SCORE_FLAGS = ("deposit_failure_flag", "withdrawal_reversal_flag", "quick_withdrawal_flag", "low_play_flag")
THREE_FLAGS = ("deposit_failure_flag", "quick_withdrawal_flag", "low_play_flag")
LISTED_FLAGS = ("deposit_failure_flag", "quick_withdrawal_flag", "low_play_flag", "high_win_rate_flag")


def _flag(rule: Column) -> Column:
    return F.when(rule, 1).otherwise(0)


def risk_composite_score(t: Tables, min_flags: int = 2, flags: Sequence[str] = SCORE_FLAGS) -> DataFrame:
    """Registered players raised by at least ``min_flags`` of the chosen rules.

    Sign-ups, deposits, withdrawals and cash play meet in one shuffle by player.
    """
    rules = _flag_rules()
    total = sum((F.col(name) for name in flags[1:]), F.col(flags[0]))
    return (
        per_player(signups(t), deposit_measures(t, attempts=True), withdrawal_measures(t, attempts=True), cash_measures(t))
        .filter(F.col("signed_up") > 0)
        .select("user_id", *[_flag(rules[name]).alias(name) for name in flags])
        .withColumn("total_flags", total)
        .filter(F.col("total_flags") >= min_flags)
        .orderBy(F.desc("total_flags"), "user_id")
    )


def risk_flags_by_country(t: Tables, min_players: int = 50) -> DataFrame:
    """Players with a quick withdrawal or many failed deposits, per country of some size."""
    rules = _flag_rules()
    flagged = _flag(rules["quick_withdrawal_flag"] | rules["deposit_failure_flag"])
    return (
        per_player(signups(t), deposit_measures(t, attempts=True), withdrawal_measures(t))
        .filter((F.col("signed_up") > 0) & F.col("country_id").isNotNull())
        .groupBy("country_id")
        .agg(F.count(F.lit(1)).alias("total_players"), F.sum(flagged).alias("flagged_players"))
        .filter(F.col("total_players") >= min_players)
        .withColumn("flag_rate_pct", pct(F.col("flagged_players"), F.col("total_players")))
        .orderBy(F.desc("flag_rate_pct"), "country_id")
    )
