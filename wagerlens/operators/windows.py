"""Segment 9: rankings, running totals and changes over time.

Lists with a row limit take their rows before the window runs, whenever the
window value of a listed row depends on listed rows only. Windows ordered over
the whole result run on monthly rows or on a list of ``n`` rows, never on all
players.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wagerlens.functions.columns import month_of, pct, quotient, succeeded
from wagerlens.model import Tables
from wagerlens.operators.financial import monthly_cash_ggr
from wagerlens.operators.players import depositor_totals, first_deposits, in_time_order, lowest_ids, moment, rows_of
from wagerlens.operators.series import cumulative, moving_average, period_change


def _by_total() -> list[Column]:
    return [F.desc("total_deposited"), F.col("user_id").asc()]


def win_rank_deposits(t: Tables, n: int = 20) -> DataFrame:
    """Rank, dense rank and decile of the top depositors.

    The decile comes from the row's position and the number of depositors: tiles
    differ by at most one row, the larger ones first.
    """
    totals = depositor_totals(t).select("user_id", "total_deposited")
    people = totals.agg(F.count("total_deposited").alias("people"))
    order = Window.orderBy(F.desc("total_deposited"))
    size, larger = F.expr("people div 10"), F.col("people") % 10
    in_larger = larger * (size + 1)
    zero_based = F.col("place") - 1
    decile = F.when(zero_based < in_larger, F.floor(zero_based / (size + 1))).otherwise(
        larger + F.floor((zero_based - in_larger) / F.greatest(size, F.lit(1)))
    )
    return (
        totals.orderBy(*_by_total())
        .limit(n)
        .crossJoin(F.broadcast(people))
        .withColumn("place", F.row_number().over(Window.orderBy(*_by_total())))
        .select(
            "user_id",
            "total_deposited",
            F.rank().over(order).alias("deposit_rank"),
            F.dense_rank().over(order).alias("dense_rank"),
            (decile + 1).alias("decile"),
        )
        .orderBy(*_by_total())
    )


def win_rank_in_country(t: Tables, n: int = 50) -> DataFrame:
    """Depositors ranked within their country, countries in order."""
    order = [F.col("country_id").asc(), *_by_total()]
    top = (
        depositor_totals(t)
        .filter(F.col("total_deposited") > 0)
        .join(t.players.filter(F.col("country_id").isNotNull()), "user_id")
        .select("user_id", "country_id", "total_deposited")
        .orderBy(*order)
        .limit(n)
    )
    rank = F.rank().over(Window.partitionBy("country_id").orderBy(F.desc("total_deposited")))
    return top.withColumn("rank_in_country", rank).orderBy(*order)


def running_totals(deposits: DataFrame, by_day: bool = False) -> DataFrame:
    """Running sum and count per player in time order; deposits of the same moment share both.

    Done in two steps so that no task needs all rows of one player: totals per
    player and hour carry the sum of earlier hours, and a window within the hour
    adds the rest. With ``by_day`` a moment is a whole day, and the carried sums
    are all there is to it.
    """
    if by_day:
        unit = ["user_id", "process_date"]
        upto = 0
    else:
        unit = ["user_id", "process_date", "hour"]
        upto = -1
        deposits = deposits.withColumn("hour", F.hour("process_ts"))
    per_unit = deposits.groupBy(*unit).agg(F.sum("amount").alias("sum"), F.count(F.lit(1)).alias("n"))
    unknown_last = [F.asc_nulls_last(c) for c in unit[1:]]
    carry = Window.partitionBy("user_id").orderBy(*unknown_last).rowsBetween(Window.unboundedPreceding, upto)
    carried = per_unit.select(
        *[F.col(c).alias(f"unit_{c}") for c in unit],
        F.sum("sum").over(carry).cast("decimal(24,2)").alias("running_total"),
        F.coalesce(F.sum("n").over(carry), F.lit(0)).alias("deposit_number"),
    )
    # a day or an hour that is not known is a unit like any other, so the units are joined null-safe
    same_unit = F.col("user_id") == F.col("unit_user_id")
    for c in unit[1:]:
        same_unit = same_unit & F.col(c).eqNullSafe(F.col(f"unit_{c}"))
    of_unit = [f"unit_{c}" for c in unit]
    if by_day:
        return deposits.join(carried, same_unit).drop(*of_unit)

    within = Window.partitionBy(*unit).orderBy("process_ts")
    known = F.sum("amount").over(within).cast("decimal(24,2)")
    before, so_far = F.col("running_total"), F.col("sum_in_hour")
    return (
        deposits.withColumns({"sum_in_hour": known, "count_in_hour": F.count(F.lit(1)).over(within)})
        .join(carried, same_unit)
        .drop(*of_unit)
        .withColumns(
            {
                # SUM skips NULL amounts: the total is NULL only until the first known amount
                "running_total": F.coalesce(before + so_far, before, so_far),
                "deposit_number": F.col("deposit_number") + F.col("count_in_hour"),
            }
        )
        .drop("hour", "sum_in_hour", "count_in_hour")
    )


def win_running_total(
    t: Tables, min_deposits: int = 10, players: int | None = 5, by_day: bool = False
) -> DataFrame:
    """Running deposits of the first ``players`` ids with ``min_deposits`` tries, in time order.

    With None, those of everyone, without sorting the whole table. With ``by_day``,
    deposits of one day share their running total.
    """
    deposits = t.deposits.filter(succeeded()).select(
        "user_id", "process_date", "process_ts", "deposit_id", "amount"
    )
    if players is not None:
        deposits = rows_of(deposits, lowest_ids(t.deposits, players, min_deposits))
    running = running_totals(deposits, by_day)
    if players is not None:
        running = running.orderBy("user_id", *in_time_order())
    return running.select("user_id", "process_date", "amount", "running_total", "deposit_number")


def win_days_since_prev(t: Tables, n: int = 50, direction: str = "prev") -> DataFrame:
    """Days between a deposit and the one before (``prev``, LAG) or after it (``next``, LEAD).

    The first ``n`` rows in player order lie within the first ``2n + 1`` deposits
    of the ``n`` lowest ids that deposited twice, as each of them loses one row.
    A deposit without a day comes last and is no day's distance from any other, so it is left out at once.
    """
    deposits = t.deposits.filter(succeeded() & F.col("process_date").isNotNull())
    order = [F.asc("user_id"), *in_time_order()]
    head = (
        rows_of(deposits, lowest_ids(deposits, n, at_least=2))
        .select("user_id", "process_date", "process_ts", "deposit_id", "amount")
        .orderBy(*order)
        .limit(2 * n + 1)
    )
    window = Window.partitionBy("user_id").orderBy(*in_time_order())
    if direction == "prev":
        other, name, days = F.lag("process_date"), "prev_deposit_date", "days_since_prev"
    else:
        other, name, days = F.lead("process_date"), "next_deposit_date", "days_to_next"
    return (
        head.withColumn(name, other.over(window))
        .withColumn(days, F.abs(F.datediff("process_date", name)))
        .filter(F.col(days).isNotNull())
        .orderBy(*order)
        .limit(n)
        .select("user_id", "process_date", "amount", name, days)
    )


def win_avg_gap(t: Tables, min_gaps: int = 5, n: int = 20) -> DataFrame:
    """Mean, least and greatest days between a player's deposits, shortest mean first.

    Deposits are first counted per player and day, so the window sees at most one
    row per calendar day. Deposits of one day are zero days apart, and all gaps
    of a player add up to the span from the first day to the last.
    """
    dated = t.deposits.filter(succeeded() & F.col("process_date").isNotNull())
    days = dated.groupBy("user_id", "process_date").agg(F.count(F.lit(1)).alias("n"))
    previous = F.lag("process_date").over(Window.partitionBy("user_id").orderBy("process_date"))
    per_player = (
        days.withColumn("gap", F.datediff("process_date", previous))
        .groupBy("user_id")
        .agg(
            (F.sum("n") - 1).alias("num_gaps"),
            F.datediff(F.max("process_date"), F.min("process_date")).alias("span"),
            F.max("n").alias("busiest"),
            F.min("gap").alias("least"),
            F.max("gap").alias("greatest"),
        )
        .filter(F.col("num_gaps") >= min_gaps)
    )
    same_day = F.col("busiest") > 1
    return (
        per_player.select(
            "user_id",
            "num_gaps",
            quotient(F.col("span"), F.col("num_gaps"), 1).alias("avg_days_between_deposits"),
            F.when(same_day, 0).otherwise(F.col("least")).alias("min_gap"),
            F.coalesce(F.col("greatest"), F.lit(0)).alias("max_gap"),
        )
        .orderBy("avg_days_between_deposits", "user_id")
        .limit(n)
    )


def _monthly_deposits(t: Tables) -> DataFrame:
    return (
        t.deposits.filter(succeeded())
        .groupBy(month_of("process_date").alias("month"))
        .agg(F.sum("amount").alias("monthly_total"))
    )


def win_mom_deposits(t: Tables) -> DataFrame:
    months = period_change(_monthly_deposits(t), "month", "monthly_total", "prev_month_total")
    change = F.col("change")
    return months.select(
        "month",
        "monthly_total",
        "prev_month_total",
        change.alias("mom_change"),
        pct(change, F.col("prev_month_total")).alias("mom_change_pct"),
    ).orderBy(F.asc_nulls_last("month"))


def win_mom_ggr(t: Tables) -> DataFrame:
    """Revenue may be negative, so the change is taken relative to the size of the month before."""
    months = period_change(monthly_cash_ggr(t).select("month", "ggr"), "month", "ggr", "prev_month_ggr")
    change, previous = F.col("change"), F.col("prev_month_ggr")
    return months.select(
        "month",
        F.round("ggr", 2).alias("ggr"),
        F.round(previous, 2).alias("prev_month_ggr"),
        F.round(change, 2).alias("mom_change"),
        pct(change, F.abs(previous)).alias("mom_change_pct"),
    ).orderBy(F.asc_nulls_last("month"))


def win_cumulative_deposits(t: Tables) -> DataFrame:
    return cumulative(_monthly_deposits(t), "month", "monthly_total", "cumulative_deposits").orderBy(F.asc_nulls_last("month"))


def win_first_last_deposit(t: Tables, n: int = 20) -> DataFrame:
    deposits = t.deposits.filter(succeeded())
    return (
        rows_of(deposits, lowest_ids(deposits, n))
        .groupBy("user_id")
        .agg(F.min(moment("amount")).alias("first"), F.max(moment("amount")).alias("last"))
        .select(
            "user_id",
            F.col("first.process_date").alias("first_deposit_date"),
            F.col("first.amount").alias("first_deposit_amount"),
            F.col("last.process_date").alias("last_deposit_date"),
            F.col("last.amount").alias("last_deposit_amount"),
        )
        .orderBy("user_id")
    )


def win_moving_avg_ggr(t: Tables, months: int = 3) -> DataFrame:
    revenue = monthly_cash_ggr(t).select("month", "ggr")
    return (
        moving_average(revenue, "month", "ggr", months, f"moving_avg_{months}m")
        .withColumn("ggr", F.round("ggr", 2))
        .orderBy(F.asc_nulls_last("month"))
    )


def win_pct_of_total(t: Tables, n: int = 30) -> DataFrame:
    """Share and running share of all deposits for the top depositors; equal totals share both.

    The running sum needs only the ``n`` highest distinct totals, which cover the
    ``n`` listed players and everyone tied with them.
    """
    totals = depositor_totals(t).select("user_id", "total_deposited")
    whole = totals.agg(F.sum("total_deposited").alias("whole"))
    downwards = Window.orderBy(F.desc("total_deposited"))
    running = (
        totals.groupBy("total_deposited")
        .agg(F.sum(F.col("total_deposited")).alias("tied"))
        .orderBy(F.desc("total_deposited"))
        .limit(n)
        .select("total_deposited", F.sum("tied").over(downwards).alias("running_total"))
    )
    return (
        totals.orderBy(*_by_total())
        .limit(n)
        .join(running, running["total_deposited"].eqNullSafe(totals["total_deposited"]))
        .drop(running["total_deposited"])
        .crossJoin(F.broadcast(whole))
        .select(
            "user_id",
            "total_deposited",
            pct(F.col("total_deposited"), F.col("whole"), 4).alias("pct_of_total"),
            "running_total",
            pct(F.col("running_total"), F.col("whole")).alias("cumulative_pct"),
        )
        .orderBy(*_by_total())
    )


def win_first_record(t: Tables, n: int = 20) -> DataFrame:
    deposits = t.deposits.filter(succeeded())
    return (
        first_deposits(rows_of(deposits, lowest_ids(deposits, n)))
        .select(
            "user_id", "deposit_id", "process_date", "amount", "pay_method_cat", F.lit(1).alias("deposit_sequence")
        )
        .orderBy("user_id")
    )
