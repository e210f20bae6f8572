"""Segment 3: how long players stay and how often they return.

A player has at most one row per calendar day once play days are made distinct,
so per-player windows below are bounded by the calendar, whoever the player is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wagerlens.functions.bands import INACTIVITY, LIFESPAN
from wagerlens.functions.columns import count_if, month_of, pct, quotient, rounded, with_share
from wagerlens.model import CASH, TOURNAMENT, Tables
from wagerlens.operators.players import lifespans

BOTH_GAMES = (CASH, TOURNAMENT)


def plays_in(t: Tables, games: Sequence[str] = BOTH_GAMES) -> DataFrame:
    """Play days of the chosen games, reading only the tables needed."""
    if set(games) == set(BOTH_GAMES):
        return t.play_days
    return t.cash_days if CASH in games else t.tourn_days


def ret_activity_window(t: Tables, n: int = 20) -> DataFrame:
    return (
        lifespans(t)
        .orderBy(F.desc("lifespan_days"), "user_id")
        .limit(n)
        .select(
            "user_id",
            F.col("first_play").alias("first_activity"),
            F.col("last_play").alias("last_activity"),
            F.col("lifespan_days").alias("days_active"),
        )
    )


def ret_lifespan_stats(t: Tables) -> DataFrame:
    days = F.col("lifespan_days")
    return lifespans(t).agg(
        F.count(F.lit(1)).alias("total_players"),
        quotient(F.sum(days), F.count(days), 0).alias("avg_lifespan_days"),
        # day counts have few distinct values, so the built-in exact percentile stays small
        rounded(F.percentile(days, 0.5), 0).alias("median_lifespan_days"),
        F.min(days).alias("min_lifespan"),
        F.max(days).alias("max_lifespan"),
    )


def _lifespan_bands(t: Tables) -> DataFrame:
    days = F.col("lifespan_days")
    counts = (
        lifespans(t)
        .groupBy(LIFESPAN.label(days).alias("retention_bucket"), LIFESPAN.position(days).alias("position"))
        .agg(F.count(F.lit(1)).alias("player_count"))
    )
    return (
        with_share(counts, "player_count").orderBy("position").select("retention_bucket", "player_count", "pct")
    )


def ret_buckets(t: Tables) -> DataFrame:
    return _lifespan_bands(t)


def ret_mau(t: Tables, games: Sequence[str] = BOTH_GAMES) -> DataFrame:
    return (
        plays_in(t, games)
        .groupBy(month_of("play_date").alias("month"))
        .agg(F.countDistinct("user_id").alias("monthly_active_players"))
        .orderBy(F.asc_nulls_last("month"))
    )


def ret_churn_buckets(t: Tables) -> DataFrame:
    """Players by how long they stayed; the same bands as ``ret_buckets``."""
    return _lifespan_bands(t)


def ret_inactive_90d(t: Tables, days: int = 90) -> DataFrame:
    """Players who have not played for more than ``days`` days before the last day in the data."""
    spans = lifespans(t)
    as_of = spans.agg(F.max("last_play").alias("as_of"))
    inactive = F.col("days_inactive")
    return (
        spans.crossJoin(F.broadcast(as_of))
        .select("user_id", "last_play", F.datediff("as_of", "last_play").alias("days_inactive"))
        .filter(inactive > days)
        .withColumn("status", INACTIVITY.label(inactive))
        .orderBy(inactive.desc(), "user_id")
    )


def ret_session_gaps(t: Tables) -> DataFrame:
    """Days between one play day and the next, in any game.

    Days are made distinct first, map-side, so that a player is at most one row per calendar
    day in the window, however often a day is repeated.
    """
    days = t.play_days.select("user_id", "play_date").distinct()
    previous = F.lag("play_date").over(Window.partitionBy("user_id").orderBy("play_date"))
    gap = F.col("gap")
    return (
        days.select(F.datediff("play_date", previous).alias("gap"))
        .filter(gap > 0)
        .agg(
            quotient(F.sum(gap), F.count(gap), 1).alias("avg_days_between_sessions"),
            rounded(F.percentile(gap, 0.5), 1).alias("median_days_between"),
            F.min(gap).alias("min_gap"),
            F.max(gap).alias("max_gap"),
        )
    )


def ret_cohort(t: Tables, months: int = 1) -> DataFrame:
    """Cohorts by month of first play, and who came back 1 … ``months`` months later."""
    active = t.play_days.select("user_id", month_of("play_date").alias("month")).distinct()
    cohort = F.min("month").over(Window.partitionBy("user_id"))
    counts = (
        active.withColumn("cohort_month", cohort)
        .groupBy("cohort_month")
        .agg(
            count_if(F.col("month") == F.col("cohort_month")).alias("cohort_size"),
            *[
                count_if(F.col("month") == F.add_months("cohort_month", k)).alias(f"month_{k}_retained")
                for k in range(1, months + 1)
            ],
        )
    )
    columns = ["cohort_month", "cohort_size"]
    for k in range(1, months + 1):
        retained = f"month_{k}_retained"
        columns += [retained, pct(F.col(retained), F.col("cohort_size")).alias(f"month_{k}_retention_pct")]
    return counts.select(*columns).orderBy("cohort_month")
