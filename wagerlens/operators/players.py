"""Per-player building blocks.

Questions that compare what a player did in several tables are answered from one
frame with one row per player. ``per_player`` reduces each table to its own
measures per player, and then groups the union of these by player once more. Each
table is shuffled once, by player, after a map-side reduction; Spark 4.1 sees that
all parts of the union are already partitioned by player and adds no shuffle for the
second step (earlier versions move one row per player and table). No side is
broadcast, no join order matters, and a player missing from a table needs no outer
join. All measures are fixed-width, so Spark aggregates by hash, and it prunes the
measures a question does not use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from wagerlens.functions.columns import succeeded
from wagerlens.model import CASH, FAILED, REVERSED, TOURNAMENT, Tables


class Measures(NamedTuple):
    """Rows of one table with a ``user_id``, and how each measure adds up per player."""

    rows: DataFrame
    how: dict[str, Callable[[str], Column]]


def _one_if(condition: Column) -> Column:
    return F.when(condition, F.lit(1).cast("bigint"))


def signups(t: Tables) -> Measures:
    rows = t.players.select("user_id", F.lit(1).cast("bigint").alias("signed_up"), "age_at_reg", "country_id")
    return Measures(rows, {"signed_up": F.sum, "age_at_reg": F.max, "country_id": F.max})


def deposit_measures(t: Tables, attempts: bool = False) -> Measures:
    """Successful deposits; with ``attempts`` also the count of all tries and of failed ones."""
    ok = succeeded()
    rows = t.deposits if attempts else t.deposits.filter(ok)
    how = {"deposits_ok": F.sum, "total_deposited": F.sum, "first_deposit_date": F.min}
    columns = [
        _one_if(ok).alias("deposits_ok"),
        F.when(ok, F.col("amount")).alias("total_deposited"),
        F.when(ok, F.col("process_date")).alias("first_deposit_date"),
    ]
    if attempts:
        how |= {"deposit_attempts": F.sum, "deposits_failed": F.sum}
        columns += [
            F.lit(1).cast("bigint").alias("deposit_attempts"),
            F.coalesce(_one_if(F.col("status") == FAILED), F.lit(0).cast("bigint")).alias("deposits_failed"),
        ]
    return Measures(rows.select("user_id", *columns), how)


def withdrawal_measures(t: Tables, attempts: bool = False) -> Measures:
    ok = succeeded()
    rows = t.withdrawals if attempts else t.withdrawals.filter(ok)
    how = {"withdrawals_ok": F.sum, "first_withdrawal_date": F.min}
    columns = [
        _one_if(ok).alias("withdrawals_ok"),
        F.when(ok, F.col("process_date")).alias("first_withdrawal_date"),
    ]
    if attempts:
        how |= {"withdrawal_attempts": F.sum, "withdrawals_reversed": F.sum}
        columns += [
            F.lit(1).cast("bigint").alias("withdrawal_attempts"),
            F.coalesce(_one_if(F.col("status") == REVERSED), F.lit(0).cast("bigint")).alias("withdrawals_reversed"),
        ]
    return Measures(rows.select("user_id", *columns), how)


_CASH_HOW = {"cash_play_days": F.sum, "cash_stakes": F.sum, "cash_winnings": F.sum}


def cash_profit() -> Column:
    """A player's net result: the difference of two sums, so that a day with one unknown side still counts with the other."""
    return F.col("cash_winnings") - F.col("cash_stakes")


def profit_over_both() -> Column:
    """The net results of both games together; a game without known sums counts as nothing."""
    nothing = F.lit(0).cast("decimal(22,5)")
    return F.coalesce(cash_profit(), nothing) + F.coalesce(F.col("tourn_winnings") - F.col("tourn_stakes"), nothing)


def cash_measures(t: Tables) -> Measures:
    rows = t.cash_days.select(
        "user_id",
        F.lit(1).cast("bigint").alias("cash_play_days"),
        F.col("stakes").alias("cash_stakes"),
        F.col("winnings").alias("cash_winnings"),
    )
    return Measures(rows, dict(_CASH_HOW))


def play_measures(t: Tables) -> Measures:
    """Both games side by side; first and last day of any play."""
    cash = F.col("game_type") == CASH
    tourn = F.col("game_type") == TOURNAMENT
    rows = t.play_days.select(
        "user_id",
        _one_if(cash).alias("cash_play_days"),
        F.when(cash, F.col("stakes")).alias("cash_stakes"),
        F.when(cash, F.col("winnings")).alias("cash_winnings"),
        F.when(cash, F.col("play_date")).alias("cash_first"),
        F.when(cash, F.col("play_date")).alias("cash_last"),
        _one_if(tourn).alias("tourn_play_days"),
        F.when(tourn, F.col("stakes")).alias("tourn_stakes"),
        F.when(tourn, F.col("winnings")).alias("tourn_winnings"),
        F.when(tourn, F.col("play_date")).alias("tourn_first"),
        F.when(tourn, F.col("play_date")).alias("tourn_last"),
        F.col("play_date").alias("first_play"),
        F.col("play_date").alias("last_play"),
    )
    how = {
        **_CASH_HOW,
        "cash_first": F.min,
        "cash_last": F.max,
        "tourn_play_days": F.sum,
        "tourn_stakes": F.sum,
        "tourn_winnings": F.sum,
        "tourn_first": F.min,
        "tourn_last": F.max,
        "first_play": F.min,
        "last_play": F.max,
    }
    return Measures(rows, how)


def per_player(*parts: Measures) -> DataFrame:
    """One row per player found in any part; measures of the other parts are NULL."""

    def reduced(rows: DataFrame, *measures: Measures) -> DataFrame:
        aggregates = [how(name).alias(name) for part in measures for name, how in part.how.items()]
        return rows.groupBy("user_id").agg(*aggregates)

    frames = [reduced(part.rows, part) for part in parts]
    if len(frames) == 1:
        return frames[0]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return reduced(rows, *parts)


def _has_player() -> Column:
    """True for every row. Said out loud, so that a reader that joins on ``user_id`` and
    one that does not get the same plan and share one scan and shuffle."""
    return F.col("user_id").isNotNull()


def depositor_totals(t: Tables) -> DataFrame:
    """Successful deposits per player: ``deposit_count``, ``total_deposited``."""
    return (
        t.deposits.filter(succeeded() & _has_player())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("deposit_count"), F.sum("amount").alias("total_deposited"))
    )


def cash_results(t: Tables) -> DataFrame:
    """Cash play per player: stakes, winnings, ``net_profit`` from the player's side, days."""
    return (
        t.cash_days.filter(_has_player())
        .groupBy("user_id")
        .agg(
            F.sum("stakes").alias("total_stakes"),
            F.sum("winnings").alias("total_winnings"),
            F.count(F.lit(1)).alias("play_days"),
        )
        .withColumn("net_profit", F.col("total_winnings") - F.col("total_stakes"))
    )


def lifespans(t: Tables) -> DataFrame:
    """First and last day of play in any game, and the days between them."""
    return (
        t.play_days.filter(_has_player())
        .groupBy("user_id")
        .agg(F.min("play_date").alias("first_play"), F.max("play_date").alias("last_play"))
        .withColumn("lifespan_days", F.datediff("last_play", "first_play"))
    )


def in_time_order() -> list[Column]:
    """Transactions by day, then by moment, unknown ones last, then by id."""
    return [F.asc_nulls_last("process_date"), F.asc_nulls_last("process_ts"), F.asc("deposit_id")]


def moment(*more: str) -> Column:
    """The same order as a struct for a minimum or maximum; ``more`` are carried along."""
    unknown_day, unknown_time = F.isnull("process_date").alias("no_day"), F.isnull("process_ts").alias("no_time")
    return F.struct(unknown_day, "process_date", unknown_time, "process_ts", "deposit_id", *more)


def first_deposits(deposits: DataFrame) -> DataFrame:
    """Each player's first successful deposit by time, ties broken by ``deposit_id``.

    The minimum of a struct is taken per task before the shuffle, so one row per
    player and task moves, however many deposits a player made.
    """
    first = F.min(moment("amount", "pay_method_cat"))
    return (
        deposits.filter(succeeded())
        .groupBy("user_id")
        .agg(first.alias("first"))
        .select("user_id", "first.deposit_id", "first.process_date", "first.amount", "first.pay_method_cat")
    )


def lowest_ids(df: DataFrame, n: int, at_least: int = 1) -> DataFrame:
    """The ``n`` smallest ``user_id`` that have ``at_least`` rows in ``df``."""
    return (
        df.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= at_least)
        .orderBy("user_id")
        .limit(n)
        .select("user_id")
    )


def rows_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the players in ``ids``. Whether these few or many ids are broadcast is left to adaptive execution."""
    return df.join(ids, "user_id", "left_semi")

