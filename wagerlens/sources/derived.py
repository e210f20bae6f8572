"""The five tables derived from TPC-H-shaped parquet, for tests, oracle checks and benchmarks.

Each player gets a start day and a span of days from ``user_id``; order and ship
dates are folded into that span, so that every retention band is filled.
All rules use integer arithmetic. See FIXTURES.md for the SQL form.

Every given row is in one of the tables: an order is a deposit or a withdrawal, a line is cash or tournament
play, a customer is a player. The remainders below say which, so that each table lacks some players; the
facts of a few customers go by another ``user_id`` that has no player row. Some facts are not
known, a few keys are repeated and a few codes are wrong, so that outer joins, sums over NULL and checks have something to find.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wagerlens.model import CASH, TOURNAMENT, Tables
from wagerlens.sources.text import RAW_COLUMNS

# Fixed values of the fixture rules.
EPOCH = "1995-01-01"
SPAN_DAYS = (0, 6, 28, 85, 170, 360, 1500, 1500)
PLAY_SHIFT = (3, 1, 0, 0, 0, 0)
UNREGISTERED = 1_000_000_000_000


def _lookup(values: tuple[int, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _day(user: str, date: str, shift: Column) -> Column:
    epoch = F.lit(EPOCH).cast("date")
    span = _lookup(SPAN_DAYS, F.col(user) % 8) + 1
    offset = F.datediff(F.col(date).cast("date"), epoch) % span
    return F.date_add(epoch, ((F.col(user) * 13) % 900 + shift + offset).cast("int"))


def _cents(units: Column) -> Column:
    # wide enough for one player with a third of a large table on one day
    return (units.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def _fact_user() -> Column:
    """The player of an order; some customers' facts belong to players who never signed up."""
    user = F.col("o_custkey")
    return F.when(user % 211 == 0, user + UNREGISTERED).otherwise(user)


def _unless(unknown: Column, value: Column) -> Column:
    return F.when(~unknown, value)


def _hundredths(column: str) -> Column:
    """A two-decimal double as a whole number. ``round`` on doubles goes through BigDecimal, this does not."""
    return F.floor(F.col(column) * 100 + 0.5)


def _div(n: Column, d: Column | int) -> Column:
    return F.call_function("div", n, F.lit(d).cast("bigint"))


# The given tables. A file that differs from them fails to be read.
GIVEN = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


class DerivedTables:
    """Same attributes as ``Tables``; each frame is built on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self._spark = spark
        self._directory = directory

    def read(self, name: str) -> DataFrame:
        """A given table; its schema is known, so no footer is read for it."""
        return self._spark.read.schema(GIVEN[name]).parquet(f"{self._directory}/{name}.parquet")

    @cached_property
    def players(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("user_id"),
            _unless(key % 97 == 0, (18 + (key * 37) % 53).cast("int")).alias("age_at_reg"),
            F.when(key % 101 == 0, F.lit(None).cast("string"))
            .when(key % 10 == 0, F.lit("F"))
            .when(key % 103 == 0, F.lit("X"))
            .otherwise(F.lit("M"))
            .alias("gender"),
            F.col("c_nationkey").alias("country_id"),
        )

    def _transactions(self, id_name: str, keep: Column, shift: Column, divisor: Column, failed_status: str) -> DataFrame:
        order = F.col("o_orderkey")
        seconds = _unless(order % 101 == 0, (order * 7919) % 86400)
        amount = _unless(order % 107 == 0, _div(_hundredths("o_totalprice"), divisor))
        dated = (
            self.read("orders")
            .filter(keep)
            .select(
                F.when(order % 1009 == 0, order - 1).otherwise(order).alias(id_name),
                _fact_user().alias("user_id"),
                _unless(order % 109 == 0, _day("o_custkey", "o_orderdate", shift)).alias("process_date"),
                seconds.alias("seconds"),
                F.concat(F.lit("method "), (order % 3).cast("string")).alias("pay_method"),
                _unless(order % 113 == 0, F.col("o_orderpriority")).alias("pay_method_cat"),
                _unless(order % 4 == 0, F.concat(F.lit("card "), (order % 5).cast("string"))).alias("card_type"),
                _cents(amount).alias("amount"),
                F.when(order % 499 == 0, F.lit("X"))
                .when(F.col("o_orderstatus") == "F", failed_status)
                .otherwise("S")
                .alias("status"),
            )
        )
        return dated.select(
            id_name,
            "user_id",
            "process_date",
            F.timestamp_add("SECOND", F.col("seconds").cast("int"), F.col("process_date").cast("timestamp_ntz")).alias(
                "process_ts"
            ),
            "pay_method",
            "pay_method_cat",
            "card_type",
            "amount",
            "status",
        )

    @staticmethod
    def _is_withdrawal() -> Column:
        """A fifth of most players' orders; all those of some players, none of others. One predicate, never NULL,
        so that it stays on this table."""
        order, user = F.col("o_orderkey"), F.col("o_custkey")
        fifth = F.when(order % 5 == 0, user % 3).otherwise(F.lit(0).cast("bigint"))
        return F.greatest(fifth, F.when(user % 11 == 0, 1).otherwise(0)) > 0

    @cached_property
    def deposits(self) -> DataFrame:
        return self._transactions(
            "deposit_id",
            ~self._is_withdrawal(),
            F.lit(0),
            100 * (1 + F.col("o_custkey") % 40) * (1 + F.col("o_orderkey") % 9),
            "F",
        )

    @cached_property
    def withdrawals(self) -> DataFrame:
        return self._transactions(
            "withdrawal_id",
            self._is_withdrawal(),
            (F.col("o_custkey") % 5) * 2,
            100 * (2 + F.col("o_custkey") % 40),
            "R",
        )

    def _plays(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        user = F.col("o_custkey")
        shift = _lookup(PLAY_SHIFT, user % 6) * (1 + user % 9)
        price = _hundredths("l_extendedprice")
        take = 10 * _hundredths("l_discount") + 6 * _hundredths("l_tax")
        return (
            self.read("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.when(self._is_tourn(), TOURNAMENT).otherwise(CASH).alias("game_type"),
                _fact_user().alias("user_id"),
                _day("o_custkey", "l_shipdate", shift).alias("play_date"),
                F.col("l_quantity").cast("int").alias("qty"),
                _unless(user % 83 == 0, _div(price, 1000)).alias("stake"),
                # some players break even, of some the winnings are not known
                F.when(user % 53 == 0, _div(price, 1000))
                .when(user % 89 != 0, _div(price * take * (7 + user % 10), 1000000))
                .alias("win"),
            )
        )

    @staticmethod
    def _is_tourn() -> Column:
        user = F.col("o_custkey")
        return ((F.col("l_linestatus") == "F") & (user % 5 != 0)) | (user % 7 == 0)

    @staticmethod
    def _daily(plays: DataFrame, *keys: str, units: Column, name: str) -> DataFrame:
        return plays.groupBy(*keys).agg(
            units.cast("bigint").alias(name),
            _cents(F.sum("stake")).alias("stakes"),
            _cents(F.sum("win")).alias("winnings"),
        )

    @cached_property
    def cash_days(self) -> DataFrame:
        plays = self._plays().filter(F.col("game_type") == CASH)
        return self._daily(plays, "user_id", "play_date", units=F.sum("qty"), name="windows")

    @cached_property
    def tourn_days(self) -> DataFrame:
        plays = self._plays().filter(F.col("game_type") == TOURNAMENT)
        return self._daily(plays, "user_id", "play_date", units=F.count(F.lit(1)), name="entries")

    @cached_property
    def play_days(self) -> DataFrame:
        """Both games from one join, where the plain union would join twice."""
        plays = self._plays()
        return plays.groupBy("game_type", "user_id", "play_date").agg(
            _cents(F.sum("stake")).alias("stakes"), _cents(F.sum("win")).alias("winnings")
        )


@lru_cache(16)
def derived_tables(spark: SparkSession, directory: str) -> DerivedTables:
    """The derived tables of a folder, whose frames are built once a session: most of a small report's time is the building of its plan."""
    return DerivedTables(spark, directory)


def as_text(t: Tables, table: str) -> DataFrame:
    """A table back in its raw all-text form; what is not known is blank where blank text is cleaned, else NULL."""
    df = getattr(t, table)
    ours = {
        "players": ["user_id", "age_at_reg", "gender", "country_id"],
        "cash_days": ["user_id", "play_date", "windows", "stakes", "winnings"],
        "tourn_days": ["user_id", "play_date", "entries", "stakes", "winnings"],
    }
    if table in ours:
        columns = [F.col(c) for c in ours[table]]
    else:
        key = "deposit_id" if table == "deposits" else "withdrawal_id"
        columns = [
            F.col("user_id"),
            F.col(key),
            F.col("process_date"),
            F.col("process_date"),
            F.substring(F.col("process_ts").cast("string"), 12, 8),
            F.col("pay_method"),
            F.col("pay_method_cat"),
            F.col("card_type"),
            F.col("amount"),
            F.col("status"),
        ]
    return df.select(
        *[
            (F.coalesce(column.cast("string"), F.lit("")) if table == "players" else column.cast("string")).alias(raw)
            for column, raw in zip(columns, RAW_COLUMNS[table])
        ]
    )
