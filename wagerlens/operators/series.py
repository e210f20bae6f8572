"""Time series of one row per period, such as a month.

The windows here run over all periods in one task: there are as many rows as
calendar months in the data. Rows must already be grouped by period; an unknown period comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wagerlens.functions.columns import quotient


def period_change(df: DataFrame, period: str, value: str, previous: str, change: str = "change") -> DataFrame:
    """Add the value of the period before, and the difference to it."""
    return df.withColumn(previous, F.lag(value).over(Window.orderBy(F.asc_nulls_last(period)))).withColumn(
        change, F.col(value) - F.col(previous)
    )


def moving_average(df: DataFrame, period: str, value: str, k: int, name: str, places: int = 2) -> DataFrame:
    """Add the mean over this period and the ``k - 1`` before, as far as they exist."""
    frame = Window.orderBy(F.asc_nulls_last(period)).rowsBetween(1 - k, 0)
    return df.withColumn(name, quotient(F.sum(value).over(frame), F.count(value).over(frame), places))


def cumulative(df: DataFrame, period: str, value: str, name: str) -> DataFrame:
    """Add the sum over this period and all before."""
    return df.withColumn(name, F.sum(value).over(Window.orderBy(F.asc_nulls_last(period))))
