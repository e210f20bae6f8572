"""Segment 6: payment health and cash flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wagerlens.functions.bands import DEPOSIT_SIZE
from wagerlens.functions.columns import (
    count_if,
    month_of,
    pct,
    quotient,
    rounded,
    succeeded,
    sum_if,
    weekday_name,
    weekday_of,
)
from wagerlens.model import REVERSED, Tables
from wagerlens.operators.financial import cash_flow_totals
from wagerlens.operators.ordered import value_stats
from wagerlens.operators.players import deposit_measures, per_player, withdrawal_measures

# Transaction labels.
DEPOSITS = "Deposits"
WITHDRAWALS = "Withdrawals"


def _both(t: Tables) -> list[tuple[str, DataFrame]]:
    return [(DEPOSITS, t.deposits), (WITHDRAWALS, t.withdrawals)]


def pay_deposit_success(t: Tables) -> DataFrame:
    return (
        t.deposits.groupBy("pay_method_cat")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            count_if(succeeded()).alias("successful"),
            sum_if(succeeded(), F.col("amount")).alias("successful_amount"),
        )
        .select(
            "pay_method_cat",
            "total_transactions",
            "successful",
            pct(F.col("successful"), F.col("total_transactions")).alias("success_rate_pct"),
            F.round("successful_amount", 2).alias("successful_amount"),
        )
        .orderBy(F.desc("total_transactions"), "pay_method_cat")
    )


def pay_withdrawal_success(t: Tables) -> DataFrame:
    return (
        t.withdrawals.groupBy("pay_method_cat")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            count_if(succeeded()).alias("successful"),
            count_if(F.col("status") == REVERSED).alias("reversed"),
            sum_if(succeeded(), F.col("amount")).alias("successful_amount"),
        )
        .select(
            "pay_method_cat",
            "total_transactions",
            "successful",
            "reversed",
            pct(F.col("successful"), F.col("total_transactions")).alias("success_rate_pct"),
            F.round("successful_amount", 2).alias("successful_amount"),
        )
        .orderBy(F.desc("total_transactions"), "pay_method_cat")
    )


def pay_cash_flow(t: Tables) -> DataFrame:
    rows = [
        df.agg(
            F.count(F.lit(1)).alias("total_transactions"),
            count_if(succeeded()).alias("successful_count"),
            F.round(sum_if(succeeded(), F.col("amount")), 2).alias("successful_amount"),
        ).select(F.lit(label).alias("transaction_type"), "*")
        for label, df in _both(t)
    ]
    return rows[0].unionByName(rows[1])


def pay_net_to_platform(t: Tables) -> DataFrame:
    return cash_flow_totals(t).withColumn("retention_pct", pct(F.col("net_to_platform"), F.col("total_deposits")))


def pay_amount_stats(t: Tables) -> DataFrame:
    def stats(label: str, df: DataFrame) -> DataFrame:
        return value_stats(df.filter(succeeded()), "amount").select(
            F.lit(label).alias("type"),
            F.col("n").alias("count"),
            quotient(F.col("total"), F.col("known"), 2).alias("avg_amount"),
            rounded(F.col("median"), 2).alias("median_amount"),
            F.round("least", 2).alias("min_amount"),
            F.round("greatest", 2).alias("max_amount"),
        )

    rows = [stats(label, df) for label, df in _both(t)]
    return rows[0].unionByName(rows[1])


def pay_time_to_first_withdrawal(t: Tables) -> DataFrame:
    days = F.col("days")
    return (
        per_player(deposit_measures(t), withdrawal_measures(t))
        .filter((F.col("deposits_ok") > 0) & (F.col("withdrawals_ok") > 0))
        .select(F.datediff("first_withdrawal_date", "first_deposit_date").alias("days"))
        .agg(
            F.count(F.lit(1)).alias("players_who_withdrew"),
            quotient(F.sum(days), F.count(days), 1).alias("avg_days_to_withdrawal"),
            rounded(F.percentile(days, 0.5), 1).alias("median_days_to_withdrawal"),
        )
    )


def pay_never_withdrew(t: Tables) -> DataFrame:
    totals = (
        per_player(deposit_measures(t), withdrawal_measures(t))
        .filter(F.col("deposits_ok") > 0)
        .agg(
            F.count(F.lit(1)).alias("total_depositors"),
            F.count("withdrawals_ok").alias("depositors_who_withdrew"),
        )
    )
    never = F.col("total_depositors") - F.col("depositors_who_withdrew")
    return totals.select(
        "*", never.alias("never_withdrew"), pct(never, F.col("total_depositors")).alias("never_withdrew_pct")
    )


def pay_monthly_trend(t: Tables) -> DataFrame:
    """Successful amount and count per month; a month with failures only shows zero."""
    rows = [
        df.groupBy(month_of("process_date").alias("month"))
        .agg(
            sum_if(succeeded(), F.col("amount")).alias("amount"),
            count_if(succeeded()).alias("count"),
        )
        .select(F.lit(label).alias("type"), "*")
        for label, df in _both(t)
    ]
    return rows[0].unionByName(rows[1]).orderBy("month", "type")


def pay_peak_hours(t: Tables) -> DataFrame:
    """All attempts are counted, successful amounts are summed."""
    return (
        t.deposits.groupBy(F.hour("process_ts").alias("hour_of_day"))
        .agg(
            F.count(F.lit(1)).alias("deposit_count"),
            F.round(sum_if(succeeded(), F.col("amount")), 2).alias("deposit_amount"),
        )
        .orderBy(F.desc("deposit_amount"), "hour_of_day")
    )


def pay_peak_weekdays(t: Tables) -> DataFrame:
    return (
        t.deposits.groupBy(weekday_of("process_date").alias("day_of_week"))
        .agg(
            F.count(F.lit(1)).alias("deposit_count"),
            F.round(sum_if(succeeded(), F.col("amount")), 2).alias("deposit_amount"),
        )
        .select(
            "day_of_week", weekday_name(F.col("day_of_week")).alias("day_name"), "deposit_count", "deposit_amount"
        )
        .orderBy("day_of_week")
    )


def pay_amount_buckets(t: Tables) -> DataFrame:
    """Successful deposits by size; an amount on a limit belongs to the lower band."""
    amount = F.col("amount")
    return (
        t.deposits.filter(succeeded())
        .groupBy(DEPOSIT_SIZE.label(amount).alias("deposit_bucket"), DEPOSIT_SIZE.position(amount).alias("position"))
        .agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("amount"), 2).alias("total_amount"))
        .orderBy("position")
        .select("deposit_bucket", "count", "total_amount")
    )
