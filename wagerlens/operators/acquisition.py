"""Segment 2: who signs up, and how they first pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wagerlens.functions.bands import AGE_AT_SIGNUP
from wagerlens.functions.columns import pct, quotient, rounded, succeeded, with_share
from wagerlens.model import Tables
from wagerlens.operators.ordered import value_stats
from wagerlens.operators.players import first_deposits


def _player_share(t: Tables, by: str, share: str) -> DataFrame:
    """Players per value of ``by`` and their share of all players, those without a value included."""
    counts = t.players.groupBy(by).agg(F.count(F.lit(1)).alias("player_count"))
    return with_share(counts, "player_count", share).filter(F.col(by).isNotNull())


def acq_player_count(t: Tables) -> DataFrame:
    return t.players.agg(F.count(F.lit(1)).alias("total_players"))


def acq_by_country(t: Tables, n: int = 15) -> DataFrame:
    shares = _player_share(t, "country_id", "pct_of_total")
    return shares.orderBy(F.desc("player_count"), "country_id").limit(n)


def acq_age_distribution(t: Tables) -> DataFrame:
    age = F.col("age_at_reg")
    banded = t.players.groupBy(
        AGE_AT_SIGNUP.label(age).alias("age_group"), AGE_AT_SIGNUP.position(age).alias("position")
    ).agg(F.count(F.lit(1)).alias("player_count"))
    return with_share(banded, "player_count").orderBy("position").select("age_group", "player_count", "pct")


def acq_gender(t: Tables) -> DataFrame:
    return _player_share(t, "gender", "pct").orderBy(F.desc("player_count"), "gender")


def acq_ftd_conversion(t: Tables) -> DataFrame:
    """Share of sign-ups that ever deposited; depositors without a player row count too."""
    signups = t.players.agg(F.count(F.lit(1)).alias("total_signups"))
    depositors = t.deposits.filter(succeeded()).agg(F.countDistinct("user_id").alias("players_who_deposited"))
    return signups.crossJoin(F.broadcast(depositors)).withColumn(
        "ftd_conversion_rate", pct(F.col("players_who_deposited"), F.col("total_signups"))
    )


def acq_first_deposit_stats(t: Tables) -> DataFrame:
    stats = value_stats(first_deposits(t.deposits), "amount")
    return stats.select(
        F.col("n").alias("players_with_deposits"),
        quotient(F.col("total"), F.col("known"), 2).alias("avg_first_deposit"),
        rounded(F.col("median"), 2).alias("median_first_deposit"),
        F.col("least").alias("min_first_deposit"),
        F.col("greatest").alias("max_first_deposit"),
    )


def acq_first_deposit_by_method(t: Tables) -> DataFrame:
    counts = first_deposits(t.deposits).groupBy("pay_method_cat").agg(F.count(F.lit(1)).alias("first_deposit_count"))
    return with_share(counts, "first_deposit_count").orderBy(F.desc("first_deposit_count"), "pay_method_cat")
