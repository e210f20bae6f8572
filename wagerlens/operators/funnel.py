"""Segment 8: from sign-up to deposit, play, withdrawal and VIP.

Stages are flags on the one-row-per-player frame, so a funnel costs one shuffle
by player and one small aggregate. More than one distinct play day is the same as
a last day after the first day, which needs no distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wagerlens.functions.bands import AGE_DECADE, TIME_TO_PLAY
from wagerlens.functions.columns import pct, rows_from, with_share
from wagerlens.model import Tables
from wagerlens.operators.players import (
    cash_measures,
    deposit_measures,
    depositor_totals,
    first_deposits,
    per_player,
    play_measures,
    signups,
    withdrawal_measures,
)
from wagerlens.operators.vip import flag_vips


def _signed_up() -> Column:
    return F.col("signed_up") > 0


def _count(name: str) -> Column:
    """Players that have measure ``name``."""
    return F.count(F.col(name))


def funnel(counts: DataFrame, stages: Sequence[tuple[str, str, str]], first: str) -> DataFrame:
    """A one-row frame of counts as stages ``(label, stage, stage before)``, as shares of ``first`` and of the one before."""
    return rows_from(
        counts,
        *[
            {
                "stage": F.lit(label),
                "count": F.col(stage),
                "pct_of_signups": pct(F.col(stage), F.col(first)),
                "pct_of_prev_stage": pct(F.col(stage), F.col(previous)),
            }
            for label, stage, previous in stages
        ],
    )


def dropoff(counts: DataFrame, steps: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A one-row frame of counts as steps ``(label, from, to)`` with the loss between; a gain is negative."""
    return rows_from(
        counts,
        *[
            {
                "stage": F.lit(label),
                "from_count": F.col(before),
                "to_count": F.col(after),
                "dropped": F.col(before) - F.col(after),
                "drop_rate_pct": pct(F.col(before) - F.col(after), F.col(before)),
            }
            for label, before, after in steps
        ],
    )


def fun_full(t: Tables) -> DataFrame:
    repeated = (F.col("cash_last") > F.col("cash_first")) | (F.col("tourn_last") > F.col("tourn_first"))
    counts = (
        per_player(signups(t), deposit_measures(t), play_measures(t), withdrawal_measures(t))
        .filter(_signed_up())
        .agg(
            _count("signed_up").alias("signed_up"),
            _count("deposits_ok").alias("deposited"),
            _count("first_play").alias("played"),
            F.count(F.when(repeated, 1)).alias("repeated"),
            _count("withdrawals_ok").alias("withdrew"),
        )
    )
    stages = [
        ("Signed Up", "signed_up", "signed_up"),
        ("Made Deposit", "deposited", "signed_up"),
        ("Made First Play", "played", "deposited"),
        ("Made Repeat Play", "repeated", "played"),
        ("Made Withdrawal", "withdrew", "repeated"),
    ]
    return funnel(counts, stages, "signed_up")


def _conversion(players: DataFrame, by: list[Column], played: str) -> DataFrame:
    depositors, plays = F.col("depositors"), F.col("players")
    return (
        players.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("signups"),
            _count("deposits_ok").alias("depositors"),
            _count(played).alias("players"),
        )
        .withColumns(
            {
                "deposit_conversion_pct": pct(depositors, F.col("signups")),
                "play_conversion_pct": pct(plays, depositors),
            }
        )
    )


def fun_by_country(t: Tables, min_signups: int = 50) -> DataFrame:
    players = per_player(signups(t), deposit_measures(t), play_measures(t)).filter(
        _signed_up() & F.col("country_id").isNotNull()
    )
    return (
        _conversion(players, [F.col("country_id")], "first_play")
        .filter(F.col("signups") >= min_signups)
        .orderBy(F.desc("deposit_conversion_pct"), "country_id")
    )


def fun_by_age(t: Tables) -> DataFrame:
    """Cash play only; the oldest band, which also holds unknown ages, is left out."""
    age = F.col("age_at_reg")
    players = per_player(signups(t), deposit_measures(t), cash_measures(t)).filter(_signed_up())
    by = [AGE_DECADE.label(age).alias("age_group"), AGE_DECADE.position(age).alias("position")]
    return (
        _conversion(players.filter(AGE_DECADE.label(age) != AGE_DECADE.otherwise), by, "cash_play_days")
        .orderBy("position")
        .drop("position")
    )


def fun_by_first_method(t: Tables, min_depositors: int = 50) -> DataFrame:
    players = t.cash_days.groupBy("user_id").agg(F.count(F.lit(1)).alias("cash_play_days"))
    return (
        first_deposits(t.deposits)
        .join(players, "user_id", "left")
        .groupBy("pay_method_cat")
        .agg(F.count(F.lit(1)).alias("depositors"), _count("cash_play_days").alias("players"))
        .filter(F.col("depositors") >= min_depositors)
        .withColumn("play_conversion_pct", pct(F.col("players"), F.col("depositors")))
        .orderBy(F.desc("play_conversion_pct"), "pay_method_cat")
    )


def fun_time_to_first_play(t: Tables, split_negative: bool = False) -> DataFrame:
    """Days from first deposit to first play.

    Play before the first deposit falls into the last band, as the catch-all;
    ``split_negative`` gives it a band of its own.
    """
    days = F.col("days")
    bands = TIME_TO_PLAY.before("Before Deposit", lambda d: d < 0) if split_negative else TIME_TO_PLAY
    counts = (
        per_player(deposit_measures(t), play_measures(t))
        .filter((F.col("deposits_ok") > 0) & F.col("first_play").isNotNull())
        .select(F.datediff("first_play", "first_deposit_date").alias("days"))
        .groupBy(bands.label(days).alias("time_to_first_play"))
        .agg(F.count(F.lit(1)).alias("player_count"), F.min(days).alias("least"))
    )
    return (
        with_share(counts, "player_count")
        .orderBy("least")
        .select("time_to_first_play", "player_count", "pct")
    )


def fun_to_vip(t: Tables, p: float = 0.95) -> DataFrame:
    signed_up = t.players.agg(F.count(F.lit(1)).alias("signups"))
    depositors = flag_vips(depositor_totals(t), p).agg(
        F.count(F.lit(1)).alias("depositors"), F.count(F.when(F.col("is_vip"), 1)).alias("vips")
    )
    counts = signed_up.crossJoin(F.broadcast(depositors))
    stages = [
        ("All Signups", F.col("signups")),
        ("Made Deposit", F.col("depositors")),
        ("Became VIP (Top 5%)", F.col("vips")),
    ]
    return rows_from(
        counts,
        *[
            {"stage": F.lit(label), "count": count, "pct": pct(count, F.col("signups"))}
            for label, count in stages
        ],
    )


def fun_dropoff(t: Tables) -> DataFrame:
    """Players lost between stages; each stage counts everyone in it, registered or not."""
    counts = per_player(signups(t), deposit_measures(t), play_measures(t), withdrawal_measures(t)).agg(
        _count("signed_up").alias("signups"),
        _count("deposits_ok").alias("depositors"),
        _count("first_play").alias("players"),
        _count("withdrawals_ok").alias("withdrawers"),
    )
    steps = [
        ("Signup → Deposit", "signups", "depositors"),
        ("Deposit → Play", "depositors", "players"),
        ("Play → Withdraw", "players", "withdrawers"),
    ]
    return dropoff(counts, steps)
