"""Segment 7: trading margin, and what players win and lose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wagerlens.functions.bands import AGE_DECADE
from wagerlens.functions.columns import month_of, pct, quotient, rounded, rows_from, weekday_name, weekday_of, with_share
from wagerlens.model import CASH, TOURNAMENT, Tables
from wagerlens.operators.financial import fin_total_ggr, stakes_and_winnings, with_hold
from wagerlens.operators.ordered import value_stats
from wagerlens.operators.players import (
    cash_measures,
    cash_profit,
    cash_results,
    per_player,
    play_measures,
    profit_over_both,
    signups,
)


def trd_margin(t: Tables) -> DataFrame:
    return fin_total_ggr(t).select(
        "game_type",
        F.round("total_stakes", 2).alias("total_stakes"),
        F.round("total_winnings", 2).alias("total_winnings"),
        F.round("ggr", 2).alias("trading_margin"),
        F.col("hold_pct").alias("margin_pct"),
    )


def trd_monthly_margin(t: Tables) -> DataFrame:
    sums = stakes_and_winnings(t.play_days, month_of("play_date").alias("month"), "game_type")
    return (
        with_hold(sums, "margin", "margin_pct")
        .select(
            "month",
            "game_type",
            *[F.round(c, 2).alias(c) for c in ("stakes", "winnings", "margin")],
            "margin_pct",
        )
        .orderBy("month", "game_type")
    )


def trd_pnl_distribution(
    t: Tables, games: Sequence[str] = (CASH, TOURNAMENT), break_even: bool = True
) -> DataFrame:
    """Cash players by the sign of their net result over ``games``.

    Without ``break_even`` there are two statuses and a zero result counts as losing.
    """
    if TOURNAMENT in games:
        players, net = per_player(play_measures(t)), profit_over_both()
    else:
        players, net = per_player(cash_measures(t)), cash_profit()
    status = F.when(net > 0, "Profitable")
    if break_even:
        status = status.when(net == 0, "Break Even")
    counts = (
        players.filter(F.col("cash_play_days") > 0)
        .groupBy(status.otherwise("Losing").alias("player_status"))
        .agg(F.count(F.lit(1)).alias("player_count"))
    )
    return with_share(counts, "player_count").orderBy(F.desc("player_count"), "player_status")


def trd_top_winners(t: Tables, n: int = 20) -> DataFrame:
    return (
        cash_results(t)
        .filter(F.col("net_profit") > 0)
        .orderBy(F.desc("net_profit"), "user_id")
        .limit(n)
        .select(
            "user_id",
            F.round("net_profit", 2).alias("net_profit"),
            F.round("total_stakes", 2).alias("total_stakes"),
            "play_days",
            pct(F.col("net_profit"), F.col("total_stakes")).alias("roi_pct"),
        )
    )


def trd_top_losers(t: Tables, n: int = 20) -> DataFrame:
    lost = F.abs(F.col("net_profit"))
    return (
        cash_results(t)
        .filter(F.col("net_profit") < 0)
        .orderBy("net_profit", "user_id")
        .limit(n)
        .select(
            "user_id",
            F.round(lost, 2).alias("amount_lost"),
            F.round("total_stakes", 2).alias("total_stakes"),
            "play_days",
            pct(lost, F.col("total_stakes")).alias("loss_pct"),
        )
    )


def _cash_players(t: Tables) -> DataFrame:
    """Registered players with cash play, with their sign-up data and net result."""
    return per_player(signups(t), cash_measures(t)).filter(
        (F.col("signed_up") > 0) & (F.col("cash_play_days") > 0)
    )


def trd_pnl_by_age(t: Tables) -> DataFrame:
    age = F.col("age_at_reg")
    return (
        _cash_players(t)
        .filter(age.isNotNull())
        .groupBy(AGE_DECADE.label(age).alias("age_group"), AGE_DECADE.position(age).alias("position"))
        .agg(
            F.count(F.lit(1)).alias("player_count"),
            quotient(F.sum(cash_profit()), F.count(cash_profit()), 2).alias("avg_profit_loss"),
            F.round(F.sum(cash_profit()), 2).alias("total_profit_loss"),
        )
        .orderBy("position")
        .drop("position")
    )


def trd_revenue_by_country(t: Tables, n: int = 15) -> DataFrame:
    revenue = -cash_profit()
    return (
        _cash_players(t)
        .filter(F.col("country_id").isNotNull())
        .groupBy("country_id")
        .agg(
            F.count(F.lit(1)).alias("player_count"),
            F.round(F.sum(revenue), 2).alias("total_house_revenue"),
            quotient(F.sum(revenue), F.count(revenue), 2).alias("avg_revenue_per_player"),
        )
        .orderBy(F.desc("total_house_revenue"), "country_id")
        .limit(n)
    )


def trd_game_preference(t: Tables) -> DataFrame:
    cash, tourn = F.col("cash_play_days").isNotNull(), F.col("tourn_play_days").isNotNull()
    totals = per_player(play_measures(t)).agg(
        F.count(F.when(cash & ~tourn, 1)).alias("cash_only"),
        F.count(F.when(tourn & ~cash, 1)).alias("tourn_only"),
        F.count(F.when(cash & tourn, 1)).alias("both"),
    )
    return rows_from(
        totals,
        {"player_type": F.lit("Cash Games Only"), "player_count": F.col("cash_only")},
        {"player_type": F.lit("Tournaments Only"), "player_count": F.col("tourn_only")},
        {"player_type": F.lit("Both (Hybrid)"), "player_count": F.col("both")},
    )


def trd_session_size(t: Tables) -> DataFrame:
    """Tables open per player-day of cash play."""
    return value_stats(t.cash_days, "windows").select(
        quotient(F.col("total"), F.col("known"), 1).alias("avg_windows_per_session"),
        rounded(F.col("median"), 1).alias("median_windows"),
        F.col("least").alias("min_windows"),
        F.col("greatest").alias("max_windows"),
    )


def trd_peak_weekdays(t: Tables) -> DataFrame:
    return (
        t.cash_days.groupBy(weekday_of("play_date").alias("day_of_week"))
        .agg(F.countDistinct("user_id").alias("unique_players"), F.sum("stakes").alias("stakes"))
        .select(
            "day_of_week",
            weekday_name(F.col("day_of_week")).alias("day_name"),
            "unique_players",
            F.round("stakes", 2).alias("total_stakes"),
        )
        .orderBy("day_of_week")
    )
