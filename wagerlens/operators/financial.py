"""Segment 1: financial performance of the house."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wagerlens.functions.columns import month_of, pct, quotient, rows_from, succeeded
from wagerlens.model import CASH, TOURNAMENT, Tables

GAMES = (CASH, TOURNAMENT)


def with_hold(df: DataFrame, margin: str = "ggr", rate: str = "hold_pct") -> DataFrame:
    """Add what the house kept, and that as a percentage of ``stakes``."""
    kept = F.col("stakes") - F.col("winnings")
    return df.select("*", kept.alias(margin), pct(kept, F.col("stakes")).alias(rate))


def stakes_and_winnings(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("stakes").alias("stakes"), F.sum("winnings").alias("winnings"))


def monthly_cash_ggr(t: Tables) -> DataFrame:
    return with_hold(stakes_and_winnings(t.cash_days, month_of("play_date").alias("month")))


def fin_total_ggr(t: Tables) -> DataFrame:
    """Stakes, winnings, gross gaming revenue and hold for each game; a row even for a game without play."""
    sums = [
        F.sum(F.when(F.col("game_type") == game, F.col(value))).alias(f"{value}_{i}")
        for i, game in enumerate(GAMES)
        for value in ("stakes", "winnings")
    ]
    per_game = rows_from(
        t.play_days.agg(*sums),
        *[
            {"game_type": F.lit(game), "stakes": F.col(f"stakes_{i}"), "winnings": F.col(f"winnings_{i}")}
            for i, game in enumerate(GAMES)
        ],
    )
    return with_hold(per_game).withColumnsRenamed({"stakes": "total_stakes", "winnings": "total_winnings"})


def fin_total_handle(t: Tables) -> DataFrame:
    def handle(game: str, name: str):
        return F.sum(F.when(F.col("game_type") == game, F.col("stakes"))).alias(name)

    totals = t.play_days.agg(handle(CASH, "cash_game_handle"), handle(TOURNAMENT, "tournament_handle"))
    return totals.select(
        (F.col("cash_game_handle") + F.col("tournament_handle")).alias("total_handle"),
        "cash_game_handle",
        "tournament_handle",
    )


def fin_hold_by_game(t: Tables) -> DataFrame:
    return fin_total_ggr(t).select("game_type", "hold_pct")


def fin_monthly_ggr(t: Tables) -> DataFrame:
    return monthly_cash_ggr(t).orderBy(F.asc_nulls_last("month"))


def fin_arpu(t: Tables) -> DataFrame:
    """Cash revenue per player who ever played cash games."""
    per_player = stakes_and_winnings(t.cash_days, "user_id").withColumn("ggr", F.col("stakes") - F.col("winnings"))
    return per_player.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.sum("ggr").alias("total_ggr"),
    ).withColumn("arpu", quotient(F.col("total_ggr"), F.col("total_players"), 2))


def cash_flow_totals(t: Tables) -> DataFrame:
    """One row: successful deposits, successful withdrawals and what stayed."""
    paid_in = t.deposits.filter(succeeded()).agg(F.sum("amount").alias("total_deposits"))
    paid_out = t.withdrawals.filter(succeeded()).agg(F.sum("amount").alias("total_withdrawals"))
    return paid_in.crossJoin(F.broadcast(paid_out)).withColumn(
        "net_to_platform", F.col("total_deposits") - F.col("total_withdrawals")
    )


def fin_net_revenue_proxy(t: Tables) -> DataFrame:
    return cash_flow_totals(t)
