"""Exact arithmetic and calendar expressions.

Money and percentages stay DECIMAL. Sums are cast to ``EXACT`` before a division
so that Spark keeps ten or more decimals of the quotient; the half-up rounding
that follows is then the rounding of the true value but for quotients within
10^-10 of a rounding limit, which were rounded there already.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, IntegerType, ShortType

from wagerlens.model import SUCCESS

EXACT = "decimal(24,5)"

# Weekday names, Sunday first.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _exact(value: Column) -> Column:
    return value.cast(EXACT)


def quotient(n: Column, d: Column, places: int) -> Column:
    """``n / d`` rounded half up; NULL when ``d`` is zero.

    Written with ``when``: ``nullif`` plans a helper projection of its own, which would
    hide an ``orderBy().limit()`` below it from Spark's top-n operator.
    """
    return F.when(d != 0, F.round(_exact(n) / _exact(d), places))


def pct(n: Column, d: Column, places: int = 2) -> Column:
    """``100 n / d`` rounded half up; NULL when ``d`` is zero."""
    return F.when(d != 0, F.round(_exact(n) * F.lit(100) / _exact(d), places))


def rounded(value: Column, places: int) -> Column:
    """Round an interpolated double half up on its decimal reading."""
    return F.round(value.cast("decimal(20,6)"), places)


def number(value: float | int | str) -> Column:
    """A parameter as an exact decimal literal."""
    return F.lit(Decimal(str(value)))


def succeeded() -> Column:
    return F.col("status") == SUCCESS


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast("decimal(12,2)")))


def month_of(date: str) -> Column:
    return F.trunc(F.col(date), "MM")


def weekday_of(date: str) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(F.col(date)) - 1


def weekday_name(number_: Column) -> Column:
    return F.get(F.array(*[F.lit(day) for day in WEEKDAYS]), number_)


def with_share(df: DataFrame, count: str, name: str = "pct") -> DataFrame:
    """Add each row's share of the column total. ``df`` must already be grouped to a few labels."""
    whole = F.sum(count).over(Window.partitionBy())
    return df.withColumn(name, pct(F.col(count), whole))


def rows_from(df: DataFrame, *rows: dict[str, Column]) -> DataFrame:
    """Turn a one-row frame into one output row per mapping."""
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def as_report(df: DataFrame) -> DataFrame:
    """Output types for readers without DECIMAL: money and ratios as DOUBLE, integers as BIGINT."""

    def cast(field):
        if isinstance(field.dataType, DecimalType):
            return F.col(f"`{field.name}`").cast("double").alias(field.name)
        if isinstance(field.dataType, (IntegerType, ShortType)):
            return F.col(f"`{field.name}`").cast("bigint").alias(field.name)
        return F.col(f"`{field.name}`")

    return df.select(*[cast(field) for field in df.schema.fields])
