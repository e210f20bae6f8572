"""Segment 4: high-value players.

A VIP is a player whose successful deposits reach the 95th percentile of
depositors. Top lists take their rows first and rank after: the rank of a row
depends only on rows above it, and those are in the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wagerlens.functions.bands import INACTIVITY
from wagerlens.functions.columns import pct, quotient
from wagerlens.model import Tables
from wagerlens.operators.ordered import exact_percentile, rank_segments
from wagerlens.operators.players import (
    cash_profit,
    cash_results,
    depositor_totals,
    lifespans,
    per_player,
    play_measures,
)

# Deposit segments as (last of twenty equal tiles, label).
PARETO_SEGMENTS = ((1, "Top 5%"), (4, "Top 6-20%"), (10, "Top 21-50%"), (20, "Bottom 50%"))
TOP_AND_OTHER = ((1, "Top 5%"), (20, "Other"))


def flag_vips(totals: DataFrame, p: float) -> DataFrame:
    """Add ``is_vip`` to depositors' totals."""
    threshold = exact_percentile(totals, "total_deposited", p, name="threshold")
    return totals.crossJoin(F.broadcast(threshold)).withColumn(
        "is_vip", F.col("total_deposited").cast("double") >= F.col("threshold")
    )


def vips(totals: DataFrame, p: float) -> DataFrame:
    return flag_vips(totals, p).filter("is_vip").drop("is_vip", "threshold")


def vip_top_depositors(t: Tables, n: int = 20) -> DataFrame:
    top = depositor_totals(t).orderBy(F.desc("total_deposited"), "user_id").limit(n)
    return top.select(
        "user_id",
        "deposit_count",
        "total_deposited",
        quotient(F.col("total_deposited"), F.col("deposit_count"), 2).alias("avg_deposit"),
        F.rank().over(Window.orderBy(F.desc("total_deposited"))).alias("deposit_rank"),
    ).orderBy(F.desc("total_deposited"), "user_id")


def vip_concentration(t: Tables, segments: Sequence[tuple[int, str]] = PARETO_SEGMENTS, tiles: int = 20) -> DataFrame:
    """Share of all deposits by depositor segment; ``segments`` ends with the last tile."""
    parts = rank_segments(depositor_totals(t), "total_deposited", tiles, segments)
    whole = F.sum("amount").over(Window.partitionBy())
    return (
        parts.withColumn("pct_of_total_deposits", pct(F.col("amount"), whole))
        .orderBy("sort_order")
        .select(
            "segment",
            F.col("n").alias("player_count"),
            F.round("amount", 2).alias("segment_deposits"),
            "pct_of_total_deposits",
        )
    )


def vip_identify(t: Tables, p: float = 0.95) -> DataFrame:
    return (
        vips(depositor_totals(t), p)
        .join(t.players, "user_id")
        .select(
            "user_id",
            "total_deposited",
            F.col("age_at_reg").alias("age"),
            "gender",
            "country_id",
            F.lit("VIP").alias("segment"),
        )
        .orderBy(F.desc("total_deposited"), "user_id")
    )


def vip_profile(t: Tables, p: float = 0.95) -> DataFrame:
    known = vips(depositor_totals(t), p).join(t.players, "user_id")
    n = F.count(F.lit(1))
    return known.agg(
        n.alias("player_count"),
        quotient(F.sum("age_at_reg"), F.count("age_at_reg"), 1).alias("avg_age"),
        pct(F.sum(F.when(F.col("gender") == "M", 1).otherwise(0)), n, 1).alias("male_pct"),
        quotient(F.sum("total_deposited"), n, 2).alias("avg_deposits"),
        F.round(F.sum("total_deposited"), 2).alias("total_deposits"),
    ).select(F.lit("VIP").alias("segment"), "*")


def vip_vs_regular(t: Tables, p: float = 0.95) -> DataFrame:
    """Cash stakes of VIP and other depositors, as shares of all cash stakes (depositor or not)."""
    depositors = flag_vips(depositor_totals(t), p).select(
        "user_id", F.when(F.col("is_vip"), "VIP").otherwise("Regular").alias("segment")
    )
    cash = cash_results(t).select("user_id", "total_stakes")
    sums = (
        depositors.join(cash, "user_id", "full")
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("player_count"),
            F.count("total_stakes").alias("stakers"),
            F.sum("total_stakes").alias("stakes"),
        )
    )
    whole = F.sum("stakes").over(Window.partitionBy())
    return (
        sums.withColumn("pct_of_stakes", pct(F.col("stakes"), whole))
        .filter(F.col("segment").isNotNull())
        .select(
            "segment",
            "player_count",
            quotient(F.col("stakes"), F.col("stakers"), 2).alias("avg_stakes"),
            F.round("stakes", 2).alias("total_stakes"),
            "pct_of_stakes",
        )
    )


def vip_at_risk(t: Tables, p: float = 0.95) -> DataFrame:
    """VIPs by days since their last play; one who never played counts as Active."""
    spans = lifespans(t).select("user_id", "last_play")
    as_of = spans.agg(F.max("last_play").alias("as_of"))
    inactive = F.col("days_inactive")
    return (
        vips(depositor_totals(t), p)
        .join(spans, "user_id", "left")
        .crossJoin(F.broadcast(as_of))
        .select(
            "user_id",
            "total_deposited",
            "last_play",
            F.datediff("as_of", "last_play").alias("days_inactive"),
        )
        .withColumn("status", INACTIVITY.label(inactive))
        .orderBy(F.desc("total_deposited"), "user_id")
    )


def vip_clv(t: Tables, n: int = 20) -> DataFrame:
    """Cash revenue per month of activity (30 days) for the players who brought most."""
    revenue = -cash_profit()
    top = (
        per_player(play_measures(t))
        .filter(F.col("cash_play_days") > 0)
        .select(
            "user_id",
            revenue.alias("total_revenue"),
            F.datediff("last_play", "first_play").alias("days"),
        )
        .filter(F.col("days") > 0)
        .orderBy(F.desc("total_revenue"), "user_id")
        .limit(n)
    )
    return top.select(
        "user_id",
        "total_revenue",
        quotient(F.col("days"), F.lit(30), 1).alias("lifespan_months"),
        quotient(F.col("total_revenue") * 30, F.col("days"), 2).alias("monthly_arpu"),
        F.rank().over(Window.orderBy(F.desc("total_revenue"))).alias("revenue_rank"),
    ).orderBy(F.desc("total_revenue"), "user_id")
