"""One player with a third of all rows, and the plans that keep that harmless."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from wagerlens.model import Tables
from wagerlens.operators import acquisition as acq
from wagerlens.operators import payments as pay
from wagerlens.operators import vip
from wagerlens.operators import windows as win
from wagerlens.plans.catalog import REPORTS
from wagerlens.operators import retention as ret
from wagerlens.sources.store import LOAD, load

ROWS = 30_000


@pytest.fixture(scope="module")
def skewed(spark) -> Tables:
    user = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 997).cast("bigint")
    day = F.date_add(F.lit("2015-02-01").cast("date"), (F.col("id") * 31 % 90).cast("int"))
    seconds = (F.col("id") * 7919 % 2000 * 43).cast("int")
    deposits = spark.range(ROWS).select(
        F.col("id").alias("deposit_id"),
        user.alias("user_id"),
        day.alias("process_date"),
        F.timestamp_add("SECOND", seconds, day.cast("timestamp_ntz")).alias("process_ts"),
        F.concat(F.lit("m"), F.col("id") % 5).alias("pay_method_cat"),
        # a third of all amounts are 10.00
        F.when(F.col("id") % 3 == 1, 10).otherwise(F.col("id") * 37 % 5000 / 100 + 1).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("id") % 11 == 0, "F").otherwise("S").alias("status"),
    )
    cash = (
        spark.range(ROWS)
        .select(user.alias("user_id"), day.alias("play_date"))
        .distinct()
        .selectExpr("user_id", "play_date", "3 AS windows", "cast(5 AS decimal(12,2)) AS stakes", "cast(user_id % 9 AS decimal(12,2)) AS winnings")
    )
    tourn = cash.filter("user_id % 2 = 0").selectExpr(
        "user_id", "play_date", "1 AS entries", "cast(stakes AS decimal(12,5)) stakes", "cast(winnings AS decimal(12,5)) winnings"
    )
    players = spark.range(1000).selectExpr(
        "id AS user_id", "cast(18 + id % 50 AS int) AS age_at_reg", "'M' AS gender", "cast(id % 3 AS int) AS country_id"
    )
    withdrawals = deposits.withColumnRenamed("deposit_id", "withdrawal_id").withColumn(
        "status", F.when(F.col("status") == "F", "R").otherwise("S")
    )
    t = Tables(players, cash, tourn, deposits, withdrawals)
    deposits.createOrReplaceTempView("d")
    return t


def same(left, right):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, left.collect()), key=key) == sorted(map(tuple, right.collect()), key=key)


def test_running_totals_equal_one_window_per_player(spark, skewed):
    plain = spark.sql(
        "SELECT user_id, process_date, amount, CAST(SUM(amount) OVER w AS decimal(24,2)) running_total,"
        " COUNT(*) OVER w deposit_number FROM d WHERE status = 'S'"
        " WINDOW w AS (PARTITION BY user_id ORDER BY process_ts)"
    )
    same(win.win_running_total(skewed, players=None), plain)


def test_gaps_equal_lag_over_all_deposits(spark, skewed):
    lagged = (
        "SELECT user_id, process_date, amount, LAG(process_date) OVER w prev, process_ts, deposit_id FROM d"
        " WHERE status = 'S' WINDOW w AS (PARTITION BY user_id ORDER BY process_ts, deposit_id)"
    )
    plain = spark.sql(
        f"SELECT user_id, count(*) n, cast(round(cast(sum(gap) AS decimal(20,5)) / count(*), 1) AS double) mean,"
        f" min(gap) lo, max(gap) hi FROM (SELECT user_id, datediff(process_date, prev) gap FROM ({lagged}) WHERE prev"
        f" IS NOT NULL) GROUP BY user_id HAVING count(*) >= 5 ORDER BY mean, user_id LIMIT 2000"
    )
    ours = win.win_avg_gap(skewed, n=2000).withColumn(
        "avg_days_between_deposits", F.col("avg_days_between_deposits").cast("double")
    )
    same(ours, plain)
    head = spark.sql(
        f"SELECT user_id, process_date, amount, prev, datediff(process_date, prev) FROM ({lagged})"
        f" WHERE prev IS NOT NULL ORDER BY user_id, process_ts, deposit_id LIMIT 500"
    )
    same(win.win_days_since_prev(skewed, n=500), head)


def test_first_deposits_equal_row_number(spark, skewed):
    plain = spark.sql(
        "SELECT pay_method_cat, count(*) n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY"
        " process_ts, deposit_id) rn FROM d WHERE status = 'S') WHERE rn = 1 GROUP BY pay_method_cat"
    )
    same(acq.acq_first_deposit_by_method(skewed).drop("pct"), plain)


def test_median_and_segments_equal_the_builtin_way(spark, skewed):
    plain = spark.sql("SELECT round(cast(percentile(amount, 0.5) AS decimal(20,6)), 2) FROM d WHERE status = 'S'").first()[0]
    assert pay.pay_amount_stats(skewed).filter("type = 'Deposits'").first().median_amount == plain
    tiles = spark.sql(
        "SELECT CASE WHEN t = 1 THEN 'Top 5%' ELSE 'Other' END s, count(*) n, sum(total) a FROM (SELECT total, ntile(20)"
        " OVER (ORDER BY total DESC) t FROM (SELECT sum(amount) total FROM d WHERE status = 'S' GROUP BY user_id)) GROUP BY 1"
    )
    ours = vip.vip_concentration(skewed, segments=vip.TOP_AND_OTHER).drop("pct_of_total_deposits")
    assert {(r.s, r.n, float(r.a)) for r in tiles.collect()} == {tuple(map(lambda v: float(v) if hasattr(v, "as_tuple") else v, r)) for r in ours.collect()}


@pytest.fixture(scope="module")
def plan_of(spark, tmp_path_factory):
    """Physical plans over a stored copy, with no side small enough to broadcast by itself."""
    store = str(tmp_path_factory.mktemp("store"))
    from wagerlens.model import SCHEMAS

    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{store}/{name}/{LOAD}")
    stored = load(spark, store)

    def plan(name):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return REPORTS[name](stored)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return plan


TOP_LISTS = [
    "acq_by_country",
    "ret_activity_window",
    "vip_top_depositors",
    "vip_clv",
    "risk_high_win_rate",
    "trd_top_winners",
    "trd_top_losers",
    "trd_revenue_by_country",
    "win_rank_deposits",
    "win_rank_in_country",
    "win_days_since_prev",
    "win_avg_gap",
    "win_pct_of_total",
    "win_first_record",
    "win_first_last_deposit",
]


@pytest.mark.parametrize("name", TOP_LISTS)
def test_top_lists_never_sort_everything(plan_of, name):
    assert "TakeOrderedAndProject" in plan_of(name)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_python_and_no_cartesian_product(plan_of, name):
    plan = plan_of(name)
    assert not re.search(r"Python|CartesianProduct|Pandas", plan)


@pytest.mark.parametrize(
    "name, tables_read",
    [
        ("vip_concentration", 1),
        ("vip_identify", 2),
        ("vip_at_risk", 3),
        ("vip_vs_regular", 2),
        ("pay_amount_stats", 2),
        ("risk_composite_score", 4),
        ("fun_full", 5),
        ("fun_to_vip", 2),
        ("win_pct_of_total", 1),
        ("win_rank_deposits", 1),
        ("ret_inactive_90d", 2),
        ("acq_first_deposit_stats", 1),
    ],
)
def test_each_table_is_read_once(plan_of, name, tables_read):
    assert plan_of(name).count("FileScan") == tables_read


@pytest.mark.parametrize("name, shuffles", [("risk_composite_score", 4), ("fun_dropoff", 4), ("risk_quick_withdrawal", 2)])
def test_players_are_shuffled_once_per_table(plan_of, name, shuffles):
    assert plan_of(name).count("Exchange hashpartitioning") == shuffles


def test_amount_filter_reaches_the_scan(plan_of):
    plan = plan_of("win_mom_deposits")
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,S)]" in plan
    assert "ReadSchema: struct<process_date:date,amount:decimal(12,2),status:string>" in plan


def test_session_gaps_reduce_repeated_days_before_the_shuffle(spark, skewed, plan_of):
    repeated = Tables(skewed.players, skewed.cash_days.unionAll(skewed.cash_days).unionAll(skewed.cash_days), skewed.tourn_days, skewed.deposits, skewed.withdrawals)
    same(ret.ret_session_gaps(repeated), ret.ret_session_gaps(skewed))
    plan = plan_of("ret_session_gaps")
    below = plan[plan.rindex("hashpartitioning(user_id") :]
    assert re.search(r"HashAggregate\(keys=\[user_id#\d+L?, play_date#\d+\], functions=\[\]", below)


def test_long_lists_are_not_broadcast_by_force(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (win.win_first_record, win.win_days_since_prev, win.win_pct_of_total, win.win_first_last_deposit):
            long = report(skewed, n=1_000_000)
            plan = long._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"BroadcastHashJoin", plan), report.__name__
            assert long.count() >= report(skewed).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
