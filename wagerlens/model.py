"""The data model: one player dimension and four facts.

``players``      one row per registered player
``cash_days``    one row per player and day with cash-game play
``tourn_days``   one row per player and day with tournament play
``deposits``     one row per deposit attempt
``withdrawals``  one row per withdrawal request

Players are not a superset of the facts: a fact row may name a ``user_id``
without a ``players`` row, so each operator says which joins it makes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

CASH = "Cash Games"
TOURNAMENT = "Tournaments"

# Transaction status codes and gender codes.
SUCCESS = "S"
FAILED = "F"
REVERSED = "R"
GENDERS = ("M", "F")
DEPOSIT_STATUSES = (SUCCESS, FAILED)
WITHDRAWAL_STATUSES = (SUCCESS, REVERSED)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


def _transactions(id_name: str) -> StructType:
    return _struct(
        (id_name, LongType(), False),
        ("user_id", LongType(), False),
        ("summary_date", DateType(), True),
        ("process_date", DateType(), True),
        ("process_ts", TimestampNTZType(), True),
        ("pay_method", StringType(), True),
        ("pay_method_cat", StringType(), True),
        ("card_type", StringType(), True),
        ("amount", DecimalType(12, 2), True),
        ("status", StringType(), True),
    )


SCHEMAS: dict[str, StructType] = {
    "players": _struct(
        ("user_id", LongType(), False),
        ("age_at_reg", IntegerType(), True),
        ("gender", StringType(), True),
        ("country_id", IntegerType(), True),
    ),
    "cash_days": _struct(
        ("user_id", LongType(), False),
        ("play_date", DateType(), False),
        ("windows", IntegerType(), True),
        ("stakes", DecimalType(12, 2), True),
        ("winnings", DecimalType(12, 2), True),
    ),
    "tourn_days": _struct(
        ("user_id", LongType(), False),
        ("play_date", DateType(), False),
        ("entries", IntegerType(), True),
        ("stakes", DecimalType(12, 5), True),
        ("winnings", DecimalType(12, 5), True),
    ),
    "deposits": _transactions("deposit_id"),
    "withdrawals": _transactions("withdrawal_id"),
}

KEYS: dict[str, tuple[str, ...]] = {
    "players": ("user_id",),
    "cash_days": ("user_id", "play_date"),
    "tourn_days": ("user_id", "play_date"),
    "deposits": ("deposit_id",),
    "withdrawals": ("withdrawal_id",),
}

DOMAINS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("players", "gender", GENDERS),
    ("deposits", "status", DEPOSIT_STATUSES),
    ("withdrawals", "status", WITHDRAWAL_STATUSES),
)


@dataclass
class Tables:
    """The five input tables. Operators take one of these and return a DataFrame."""

    players: DataFrame
    cash_days: DataFrame
    tourn_days: DataFrame
    deposits: DataFrame
    withdrawals: DataFrame

    @cached_property
    def play_days(self) -> DataFrame:
        """Both games, tagged with ``game_type``: player-days for questions that span games."""
        columns = ["user_id", "play_date", "stakes", "winnings"]
        cash = self.cash_days.select(F.lit(CASH).alias("game_type"), *columns)
        tourn = self.tourn_days.select(F.lit(TOURNAMENT).alias("game_type"), *columns)
        return cash.unionByName(tourn)
