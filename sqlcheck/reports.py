"""One SQL statement per report."""

from __future__ import annotations

from sqlcheck.base import big, dbl, median, month, pct, ratio, sql

OK = "status='S'"
ORACLES: dict[str, str] = {}

# --- checks and cleaning -------------------------------------------------------

_ALL = "players cash_days tourn_days deposits withdrawals"
_KEYS = {
    "players": "user_id",
    "cash_days": "user_id,play_date",
    "tourn_days": "user_id,play_date",
    "deposits": "deposit_id",
    "withdrawals": "withdrawal_id",
}


def _key_check(table: str, key: str) -> str:
    blank = " OR ".join(f"{c} IS NULL" for c in key.split(","))
    return (
        f"SELECT '{table}' AS tbl, '{key}' AS key,"
        f" (SELECT COUNT(*) FROM (SELECT {key} FROM {table} WHERE NOT ({blank}) GROUP BY {key} HAVING COUNT(*)>1))"
        f" AS duplicates, (SELECT COUNT(*) FROM {table} WHERE {blank}) AS null_keys"
    )


def _domain_check(table: str, column: str, allowed: str) -> str:
    return (
        f"SELECT '{table}' AS tbl, '{column}' AS column_name,"
        f" COUNT(*) FILTER (WHERE {column} NOT IN ({allowed})) AS bad_rows,"
        f" COUNT(*) FILTER (WHERE {column} IS NULL) AS null_rows FROM {table}"
    )


ORACLES["verify_row_counts"] = sql(
    _ALL, " UNION ALL ".join(f"SELECT '{name}' AS tbl, COUNT(*) AS rows FROM {name}" for name in _KEYS)
)
ORACLES["check_keys"] = sql(_ALL, " UNION ALL ".join(_key_check(name, key) for name, key in _KEYS.items()))
ORACLES["check_keys_lineitem"] = _key_check("lineitem", "l_orderkey,l_linenumber")
ORACLES["check_domains"] = sql(
    "players deposits withdrawals",
    " UNION ALL ".join(
        [
            _domain_check("players", "gender", "'M','F'"),
            _domain_check("deposits", "status", "'S','F'"),
            _domain_check("withdrawals", "status", "'S','R'"),
        ]
    ),
)
ORACLES["clean_players"] = sql(
    "players",
    f"SELECT user_id, {big('age_at_reg')} AS age_at_reg, gender, {big('country_id')} AS country_id FROM players",
)
for _name, _table, _units in (("clean_cash", "cash_days", "windows"), ("clean_tournaments", "tourn_days", "entries")):
    ORACLES[_name] = sql(
        _table,
        f"SELECT user_id, play_date, {big(_units)} AS {_units}, {dbl('stakes')} AS stakes,"
        f" {dbl('winnings')} AS winnings FROM {_table}",
    )
for _name, _table, _id in (
    ("clean_deposits", "deposits", "deposit_id"),
    ("clean_withdrawals", "withdrawals", "withdrawal_id"),
):
    ORACLES[_name] = sql(
        _table,
        f"SELECT {_id}, user_id, process_date AS summary_date, process_date, pay_method, pay_method_cat, card_type,"
        f" {dbl('amount')} AS amount, status,"
        " CAST(TIME '00:00:00' + to_seconds(process_sec) AS VARCHAR) AS process_time"
        f" FROM {_table}",
    )

# --- 1 financial ---------------------------------------------------------------

_GAME_SUMS = "SELECT game_type, SUM(stakes) AS s, SUM(winnings) AS w FROM play_days GROUP BY game_type"
ORACLES["fin_total_ggr"] = sql(
    "play_days",
    f"SELECT game_type, {dbl('s')} AS total_stakes, {dbl('w')} AS total_winnings, {dbl('s-w')} AS ggr,"
    f" {pct('s-w', 's')} AS hold_pct FROM game",
    game=_GAME_SUMS,
)
ORACLES["fin_total_handle"] = sql(
    "cash_days tourn_days",
    f"SELECT {dbl('c+t')} AS total_handle, {dbl('c')} AS cash_game_handle, {dbl('t')} AS tournament_handle"
    " FROM (SELECT SUM(stakes) AS c FROM cash_days), (SELECT SUM(stakes) AS t FROM tourn_days)",
)
ORACLES["fin_hold_by_game"] = sql("play_days", f"SELECT game_type, {pct('s-w', 's')} AS hold_pct FROM game", game=_GAME_SUMS)
ORACLES["fin_monthly_ggr"] = sql(
    "month_ggr",
    f"SELECT month, {dbl('stakes')} AS stakes, {dbl('winnings')} AS winnings, {dbl('ggr')} AS ggr,"
    f" {pct('ggr', 'stakes')} AS hold_pct FROM month_ggr",
)
ORACLES["fin_arpu"] = sql(
    "cash",
    "SELECT COUNT(DISTINCT user_id) AS total_players,"
    f" {dbl('SUM(stakes-winnings)')} AS total_ggr,"
    f" {ratio('SUM(stakes-winnings)', 'COUNT(DISTINCT user_id)')} AS arpu FROM cash",
)
_FLOW = "(SELECT SUM(amount) AS i FROM paid_in), (SELECT SUM(amount) AS o FROM paid_out)"
_FLOW_COLUMNS = f"{dbl('i')} AS total_deposits, {dbl('o')} AS total_withdrawals, {dbl('i-o')} AS net_to_platform"
ORACLES["fin_net_revenue_proxy"] = sql("paid_in paid_out", f"SELECT {_FLOW_COLUMNS} FROM {_FLOW}")

# --- 2 acquisition -------------------------------------------------------------

_PEOPLE = "(SELECT COUNT(*) FROM players)"
ORACLES["acq_player_count"] = sql("players", "SELECT COUNT(*) AS total_players FROM players")
ORACLES["acq_by_country"] = sql(
    "players",
    f"SELECT {big('country_id')} AS country_id, COUNT(*) AS player_count, {pct('COUNT(*)', _PEOPLE)} AS pct_of_total"
    " FROM players WHERE country_id IS NOT NULL GROUP BY players.country_id ORDER BY 2 DESC, 1 LIMIT 15",
)
_AGE = (
    # fixed values: the labels and limits of the age bands
    "CASE WHEN age_at_reg IS NULL THEN 'Unknown' WHEN age_at_reg<21 THEN 'Under 21'"
    " WHEN age_at_reg BETWEEN 21 AND 25 THEN '21-25' WHEN age_at_reg BETWEEN 26 AND 30 THEN '26-30'"
    " WHEN age_at_reg BETWEEN 31 AND 35 THEN '31-35' WHEN age_at_reg BETWEEN 36 AND 40 THEN '36-40'"
    " WHEN age_at_reg BETWEEN 41 AND 45 THEN '41-45' WHEN age_at_reg BETWEEN 46 AND 55 THEN '46-55' ELSE '55+' END"
)
ORACLES["acq_age_distribution"] = sql(
    "players",
    f"SELECT {_AGE} AS age_group, COUNT(*) AS player_count, {pct('COUNT(*)', _PEOPLE)} AS pct FROM players GROUP BY 1",
)
ORACLES["acq_gender"] = sql(
    "players",
    f"SELECT gender, COUNT(*) AS player_count, {pct('COUNT(*)', _PEOPLE)} AS pct"
    " FROM players WHERE gender IS NOT NULL GROUP BY gender",
)
ORACLES["acq_ftd_conversion"] = sql(
    "players paid_in",
    f"SELECT {_PEOPLE} AS total_signups, n AS players_who_deposited, {pct('n', _PEOPLE)} AS ftd_conversion_rate"
    " FROM (SELECT COUNT(DISTINCT user_id) AS n FROM paid_in)",
)
ORACLES["acq_first_deposit_stats"] = sql(
    "firsts",
    f"SELECT COUNT(*) AS players_with_deposits, {ratio('SUM(amount)', 'COUNT(amount)')} AS avg_first_deposit,"
    f" {median('amount', 2)} AS median_first_deposit, {dbl('MIN(amount)')} AS min_first_deposit,"
    f" {dbl('MAX(amount)')} AS max_first_deposit FROM firsts",
)
ORACLES["acq_first_deposit_by_method"] = sql(
    "firsts",
    f"SELECT pay_method_cat, COUNT(*) AS first_deposit_count, {pct('COUNT(*)', '(SELECT COUNT(*) FROM firsts)')} AS pct"
    " FROM firsts GROUP BY pay_method_cat",
)

# --- 3 retention ---------------------------------------------------------------

ORACLES["ret_activity_window"] = sql(
    "spans",
    "SELECT user_id, first_play AS first_activity, last_play AS last_activity, days AS days_active FROM spans"
    " ORDER BY days DESC, user_id LIMIT 20",
)
ORACLES["ret_lifespan_stats"] = sql(
    "spans",
    f"SELECT COUNT(*) AS total_players, {ratio('SUM(days)', 'COUNT(*)', 0)} AS avg_lifespan_days,"
    f" {median('days', 0)} AS median_lifespan_days, MIN(days) AS min_lifespan, MAX(days) AS max_lifespan FROM spans",
)
_STAY = (
    "CASE WHEN days<1 THEN '1 day only' WHEN days<=7 THEN '2-7 days' WHEN days<=30 THEN '8-30 days'"
    " WHEN days<=90 THEN '1-3 months' WHEN days<=180 THEN '3-6 months' WHEN days<=365 THEN '6-12 months'"
    " ELSE '12+ months' END"
)
ORACLES["ret_buckets"] = ORACLES["ret_churn_buckets"] = sql(
    "spans",
    f"SELECT {_STAY} AS retention_bucket, COUNT(*) AS player_count,"
    f" {pct('COUNT(*)', '(SELECT COUNT(*) FROM spans)')} AS pct FROM spans GROUP BY 1",
)
for _name, _table in (("ret_mau", "play_days"), ("ret_mau_cash", "cash_days")):
    ORACLES[_name] = sql(
        _table,
        f"SELECT {month('play_date')} AS month, COUNT(DISTINCT user_id) AS monthly_active_players"
        f" FROM {_table} GROUP BY 1",
    )
_IDLE = "DATE_DIFF('day', last_play, (SELECT MAX(last_play) FROM spans))"
ORACLES["ret_inactive_90d"] = sql(
    "spans",
    f"SELECT user_id, last_play, {_IDLE} AS days_inactive, 'Churned' AS status FROM spans WHERE {_IDLE}>90",
)
ORACLES["ret_session_gaps"] = sql(
    "play_days",
    f"SELECT {ratio('SUM(gap)', 'COUNT(gap)', 1)} AS avg_days_between_sessions, {median('gap', 1)} AS median_days_between,"
    " MIN(gap) AS min_gap, MAX(gap) AS max_gap FROM gaps WHERE gap>0",
    gaps="SELECT DATE_DIFF('day', LAG(play_date) OVER (PARTITION BY user_id ORDER BY play_date), play_date) AS gap"
    " FROM (SELECT DISTINCT user_id, play_date FROM play_days)",
)
ORACLES["ret_cohort"] = sql(
    "spans",
    f"SELECT cohort_month, COUNT(*) AS cohort_size, {big('SUM(back)')} AS month_1_retained,"
    f" {pct('SUM(back)', 'COUNT(*)')} AS month_1_retention_pct FROM people GROUP BY cohort_month",
    people=f"SELECT {month('first_play')} AS cohort_month, CASE WHEN EXISTS (SELECT 1 FROM play_days d"
    " WHERE d.user_id=spans.user_id"
    f" AND {month('d.play_date')}=CAST({month('spans.first_play')} + INTERVAL 1 MONTH AS DATE)) THEN 1 ELSE 0 END AS back"
    " FROM spans",
)

# --- 4 VIP ---------------------------------------------------------------------

ORACLES["vip_top_depositors"] = sql(
    "totals",
    f"SELECT user_id, deposit_count, {dbl('total')} AS total_deposited, {ratio('total', 'deposit_count')} AS avg_deposit,"
    " 1+(SELECT COUNT(*) FROM totals h WHERE h.total>totals.total) AS deposit_rank"
    " FROM totals ORDER BY totals.total DESC, user_id LIMIT 20",
)


def _concentration(label: str) -> str:
    return sql(
        "totals",
        f"SELECT {label} AS segment, COUNT(*) AS player_count, {dbl('SUM(total)')} AS segment_deposits,"
        f" {pct('SUM(total)', '(SELECT SUM(total) FROM totals)')} AS pct_of_total_deposits FROM tiled GROUP BY 1",
        tiled="SELECT total, NTILE(20) OVER (ORDER BY total DESC, user_id) AS tile FROM totals",
    )


ORACLES["vip_concentration"] = _concentration(
    "CASE WHEN tile>10 THEN 'Bottom 50%' WHEN tile>4 THEN 'Top 21-50%' WHEN tile>1 THEN 'Top 6-20%' ELSE 'Top 5%' END"
)
ORACLES["vip_concentration_two_segments"] = _concentration("CASE WHEN tile>1 THEN 'Other' ELSE 'Top 5%' END")
ORACLES["vip_identify"] = sql(
    "players vips",
    f"SELECT user_id, {dbl('total')} AS total_deposited, {big('age_at_reg')} AS age, gender,"
    f" {big('country_id')} AS country_id, 'VIP' AS segment FROM vips JOIN players USING (user_id)",
)
_MEN = "COUNT(*) FILTER (WHERE gender='M')"
ORACLES["vip_profile"] = sql(
    "players vips",
    "SELECT 'VIP' AS segment, COUNT(*) AS player_count,"
    f" {ratio('SUM(age_at_reg)', 'COUNT(age_at_reg)', 1)} AS avg_age,"
    f" {pct(_MEN, 'COUNT(*)', 1)} AS male_pct,"
    f" {ratio('SUM(total)', 'COUNT(*)')} AS avg_deposits, {dbl('SUM(total)')} AS total_deposits"
    " FROM vips JOIN players USING (user_id)",
)
ORACLES["vip_vs_regular"] = sql(
    "totals cut cash",
    f"SELECT CASE WHEN {dbl('total')}>=p95 THEN 'VIP' ELSE 'Regular' END AS segment, COUNT(*) AS player_count,"
    f" {ratio('SUM(stakes)', 'COUNT(stakes)')} AS avg_stakes, {dbl('SUM(stakes)')} AS total_stakes,"
    f" {pct('SUM(stakes)', '(SELECT SUM(stakes) FROM cash)')} AS pct_of_stakes"
    " FROM totals CROSS JOIN cut LEFT JOIN cash USING (user_id) GROUP BY 1",
)
ORACLES["vip_at_risk"] = sql(
    "vips spans",
    f"SELECT user_id, {dbl('total')} AS total_deposited, last_play, {_IDLE} AS days_inactive,"
    f" CASE WHEN {_IDLE}>90 THEN 'Churned' WHEN {_IDLE}>60 THEN 'At High Risk' WHEN {_IDLE}>30 THEN 'At Risk'"
    " ELSE 'Active' END AS status FROM vips LEFT JOIN spans USING (user_id)",
)
ORACLES["vip_clv"] = sql(
    "cash spans",
    f"SELECT user_id, {dbl('ggr')} AS total_revenue, {ratio('days', '30', 1)} AS lifespan_months,"
    f" {ratio('30*ggr', 'days')} AS monthly_arpu, RANK() OVER (ORDER BY ggr DESC) AS revenue_rank"
    " FROM earned ORDER BY ggr DESC, user_id LIMIT 20",
    earned="SELECT user_id, stakes-winnings AS ggr, spans.days AS days FROM cash JOIN spans USING (user_id)"
    " WHERE spans.days>0",
)

# --- 5 risk --------------------------------------------------------------------


def _loss_rate(table: str, by: str, total: str, lost: str, code: str, rate: str, having: str = "") -> str:
    losses = f"COUNT(*) FILTER (WHERE status='{code}')"
    return sql(
        table,
        f"SELECT {by}, COUNT(*) AS {total}, COUNT(*) FILTER (WHERE {OK}) AS successful, {losses} AS {lost},"
        f" {pct(losses, 'COUNT(*)')} AS {rate} FROM {table} GROUP BY {by} {having}",
    )


_FAILS = "COUNT(*)>=5 AND 2*COUNT(*) FILTER (WHERE status='F')>COUNT(*)"
_BACKS = "COUNT(*)>=3 AND 10*COUNT(*) FILTER (WHERE status='R')>7*COUNT(*)"
ORACLES["risk_deposit_failure_by_method"] = _loss_rate(
    "deposits", "pay_method_cat", "total_attempts", "failed", "F", "failure_rate_pct"
)
ORACLES["risk_high_deposit_failure"] = _loss_rate(
    "deposits", "user_id", "total_deposits", "failed", "F", "failure_rate", f"HAVING {_FAILS}"
)
ORACLES["risk_reversal_by_method"] = _loss_rate(
    "withdrawals", "pay_method_cat", "total_attempts", "reversed", "R", "reversal_rate_pct"
)
ORACLES["risk_high_reversal"] = _loss_rate(
    "withdrawals", "user_id", "total_withdrawals", "reversed", "R", "reversal_rate", f"HAVING {_BACKS}"
)
_QUICK = "FROM in_dates JOIN out_dates USING (user_id) WHERE DATE_DIFF('day', first_in, first_out)<=1"
ORACLES["risk_quick_withdrawal"] = sql(
    "in_dates out_dates",
    "SELECT user_id, first_in AS first_deposit_date, first_out AS first_withdrawal_date,"
    f" DATE_DIFF('day', first_in, first_out) AS days_to_withdraw {_QUICK}",
)
_LOW = "FROM totals LEFT JOIN cash USING (user_id) WHERE total>=100 AND 2*COALESCE(stakes,0)<total"
ORACLES["risk_low_play"] = sql(
    "totals cash",
    f"SELECT user_id, {dbl('total')} AS total_deposited, {dbl('COALESCE(stakes,0)')} AS total_stakes,"
    f" {pct('COALESCE(stakes,0)', 'total')} AS play_ratio_pct {_LOW}",
)
_WINS = "FROM cash WHERE stakes>100 AND 100*(winnings-stakes)>20*stakes"
ORACLES["risk_high_win_rate"] = sql(
    "cash",
    f"SELECT user_id, {dbl('stakes')} AS total_stakes, {dbl('winnings')} AS total_winnings,"
    f" {dbl('winnings-stakes')} AS net_profit, days AS play_days, {pct('winnings-stakes', 'stakes')} AS return_pct"
    f" {_WINS} ORDER BY return_pct DESC, user_id LIMIT 50",
)
_RULES = {
    "deposit_failure_flag": f"SELECT user_id FROM deposits GROUP BY user_id HAVING {_FAILS}",
    "withdrawal_reversal_flag": f"SELECT user_id FROM withdrawals GROUP BY user_id HAVING {_BACKS}",
    "quick_withdrawal_flag": f"SELECT user_id {_QUICK}",
    "low_play_flag": f"SELECT user_id {_LOW}",
    "high_win_rate_flag": f"SELECT user_id {_WINS}",
}
_RISK_TABLES = "players deposits withdrawals in_dates out_dates totals cash"


def _score(*flags: str) -> str:
    columns = ", ".join(
        f"CAST(CASE WHEN user_id IN ({_RULES[flag]}) THEN 1 ELSE 0 END AS BIGINT) AS {flag}" for flag in flags
    )
    return sql(
        _RISK_TABLES,
        f"SELECT *, {'+'.join(flags)} AS total_flags FROM flagged WHERE {'+'.join(flags)}>=2",
        flagged=f"SELECT user_id, {columns} FROM players",
    )


ORACLES["risk_composite_score"] = _score(*list(_RULES)[:4])
ORACLES["risk_score_three_flags"] = _score("deposit_failure_flag", "quick_withdrawal_flag", "low_play_flag")
ORACLES["risk_score_listed_flags"] = _score(
    "deposit_failure_flag", "quick_withdrawal_flag", "low_play_flag", "high_win_rate_flag"
)
ORACLES["risk_flags_by_country"] = sql(
    _RISK_TABLES,
    f"SELECT {big('country_id')} AS country_id, COUNT(*) AS total_players, {big('SUM(flag)')} AS flagged_players,"
    f" {pct('SUM(flag)', 'COUNT(*)')} AS flag_rate_pct"
    " FROM flagged WHERE country_id IS NOT NULL GROUP BY flagged.country_id HAVING COUNT(*)>=50",
    suspects=f"{_RULES['quick_withdrawal_flag']} UNION {_RULES['deposit_failure_flag']}",
    flagged="SELECT country_id, CASE WHEN user_id IN (SELECT user_id FROM suspects) THEN 1 ELSE 0 END AS flag"
    " FROM players",
)

# --- 6 payments ----------------------------------------------------------------

_DONE = f"COUNT(*) FILTER (WHERE {OK})"
_DONE_AMOUNT = dbl(f"SUM(CASE WHEN {OK} THEN amount ELSE 0 END)")
ORACLES["pay_deposit_success"] = sql(
    "deposits",
    f"SELECT pay_method_cat, COUNT(*) AS total_transactions, {_DONE} AS successful,"
    f" {pct(_DONE, 'COUNT(*)')} AS success_rate_pct, {_DONE_AMOUNT} AS successful_amount"
    " FROM deposits GROUP BY pay_method_cat",
)
ORACLES["pay_withdrawal_success"] = sql(
    "withdrawals",
    f"SELECT pay_method_cat, COUNT(*) AS total_transactions, {_DONE} AS successful,"
    f" COUNT(*) FILTER (WHERE status='R') AS reversed, {pct(_DONE, 'COUNT(*)')} AS success_rate_pct,"
    f" {_DONE_AMOUNT} AS successful_amount FROM withdrawals GROUP BY pay_method_cat",
)
_BOTH = (("Deposits", "deposits"), ("Withdrawals", "withdrawals"))
ORACLES["pay_cash_flow"] = sql(
    "deposits withdrawals",
    " UNION ALL ".join(
        f"SELECT '{label}' AS transaction_type, COUNT(*) AS total_transactions, {_DONE} AS successful_count,"
        f" {_DONE_AMOUNT} AS successful_amount FROM {table}"
        for label, table in _BOTH
    ),
)
ORACLES["pay_net_to_platform"] = sql(
    "paid_in paid_out", f"SELECT {_FLOW_COLUMNS}, {pct('i-o', 'i')} AS retention_pct FROM {_FLOW}"
)
ORACLES["pay_amount_stats"] = sql(
    "paid_in paid_out",
    " UNION ALL ".join(
        f"SELECT '{label}' AS type, COUNT(*) AS count, {ratio('SUM(amount)', 'COUNT(amount)')} AS avg_amount,"
        f" {median('amount', 2)} AS median_amount, {dbl('MIN(amount)')} AS min_amount,"
        f" {dbl('MAX(amount)')} AS max_amount FROM {table}"
        for label, table in (("Deposits", "paid_in"), ("Withdrawals", "paid_out"))
    ),
)
ORACLES["pay_time_to_first_withdrawal"] = sql(
    "in_dates out_dates",
    f"SELECT COUNT(*) AS players_who_withdrew, {ratio('SUM(d)', 'COUNT(d)', 1)} AS avg_days_to_withdrawal,"
    f" {median('d', 1)} AS median_days_to_withdrawal FROM waits",
    waits="SELECT DATE_DIFF('day', first_in, first_out) AS d FROM in_dates JOIN out_dates USING (user_id)",
)
ORACLES["pay_never_withdrew"] = sql(
    "in_dates out_dates",
    f"SELECT n AS total_depositors, w AS depositors_who_withdrew, n-w AS never_withdrew, {pct('n-w', 'n')}"
    " AS never_withdrew_pct FROM (SELECT COUNT(*) AS n, COUNT(o.user_id) AS w"
    " FROM in_dates i LEFT JOIN out_dates o ON i.user_id=o.user_id)",
)
ORACLES["pay_monthly_trend"] = sql(
    "deposits withdrawals",
    " UNION ALL ".join(
        f"SELECT '{label}' AS type, {month('process_date')} AS month, {_DONE_AMOUNT} AS amount, {_DONE} AS count"
        f" FROM {table} GROUP BY 2"
        for label, table in _BOTH
    ),
)
ORACLES["pay_peak_hours"] = sql(
    "deposits",
    f"SELECT process_sec//3600 AS hour_of_day, COUNT(*) AS deposit_count, {_DONE_AMOUNT} AS deposit_amount"
    " FROM deposits GROUP BY 1",
)
ORACLES["pay_peak_weekdays"] = sql(
    "deposits",
    "SELECT dayofweek(process_date) AS day_of_week, dayname(process_date) AS day_name, COUNT(*) AS deposit_count,"
    f" {_DONE_AMOUNT} AS deposit_amount FROM deposits GROUP BY 1, 2",
)
ORACLES["pay_amount_buckets"] = sql(
    "paid_in",
    "SELECT CASE WHEN amount<10 THEN '< €10' WHEN amount BETWEEN 10 AND 20 THEN '€10-20' WHEN amount BETWEEN 20 AND 50"
    " THEN '€20-50' WHEN amount BETWEEN 50 AND 100 THEN '€50-100' WHEN amount BETWEEN 100 AND 500 THEN '€100-500'"
    " WHEN amount BETWEEN 500 AND 1000 THEN '€500-1000' ELSE '€1000+' END"
    f" AS deposit_bucket, COUNT(*) AS count, {dbl('SUM(amount)')} AS total_amount FROM paid_in GROUP BY 1",
)

# --- 7 trading -----------------------------------------------------------------

ORACLES["trd_margin"] = sql(
    "play_days",
    f"SELECT game_type, {dbl('ROUND(s,2)')} AS total_stakes, {dbl('ROUND(w,2)')} AS total_winnings,"
    f" {dbl('ROUND(s-w,2)')} AS trading_margin, {pct('s-w', 's')} AS margin_pct FROM game",
    game=_GAME_SUMS,
)
ORACLES["trd_monthly_margin"] = sql(
    "play_days",
    f"SELECT month, game_type, {dbl('s')} AS stakes, {dbl('w')} AS winnings, {dbl('s-w')} AS margin,"
    f" {pct('s-w', 's')} AS margin_pct FROM game",
    game=f"SELECT {month('play_date')} AS month, game_type, SUM(stakes) AS s, SUM(winnings) AS w"
    " FROM play_days GROUP BY 1, 2",
)
_SHARE_OF_NET = pct("COUNT(*)", "(SELECT COUNT(*) FROM net)")
ORACLES["trd_pnl_distribution"] = sql(
    "cash tourn",
    "SELECT CASE sign(profit) WHEN 1 THEN 'Profitable' WHEN 0 THEN 'Break Even' ELSE 'Losing' END AS player_status,"
    f" COUNT(*) AS player_count, {_SHARE_OF_NET} AS pct FROM net GROUP BY 1",
    net="SELECT cash.user_id, COALESCE(cash.winnings-cash.stakes,0)+COALESCE(tourn.winnings-tourn.stakes,0) AS profit"
    " FROM cash LEFT JOIN tourn USING (user_id)",
)
ORACLES["trd_pnl_cash_only"] = sql(
    "cash",
    "SELECT CASE WHEN winnings>stakes THEN 'Profitable' ELSE 'Losing' END AS player_status, COUNT(*) AS player_count,"
    f" {_SHARE_OF_NET} AS pct FROM net GROUP BY 1",
    net="SELECT * FROM cash",
)
ORACLES["trd_top_winners"] = sql(
    "cash",
    f"SELECT user_id, {dbl('winnings-stakes')} AS net_profit, {dbl('stakes')} AS total_stakes, days AS play_days,"
    f" {pct('winnings-stakes', 'stakes')} AS roi_pct FROM cash WHERE winnings>stakes"
    " ORDER BY winnings-stakes DESC, user_id LIMIT 20",
)
ORACLES["trd_top_losers"] = sql(
    "cash",
    f"SELECT user_id, {dbl('stakes-winnings')} AS amount_lost, {dbl('stakes')} AS total_stakes, days AS play_days,"
    f" {pct('stakes-winnings', 'stakes')} AS loss_pct FROM cash WHERE winnings<stakes"
    " ORDER BY stakes-winnings DESC, user_id LIMIT 20",
)
_DECADE = (
    # fixed values: the labels and limits of the age bands
    "CASE WHEN age_at_reg<25 THEN 'Under 25' WHEN age_at_reg BETWEEN 25 AND 34 THEN '25-34'"
    " WHEN age_at_reg BETWEEN 35 AND 44 THEN '35-44' WHEN age_at_reg BETWEEN 45 AND 54 THEN '45-54' ELSE '55+' END"
)
ORACLES["trd_pnl_by_age"] = sql(
    "cash players",
    f"SELECT {_DECADE} AS age_group, COUNT(*) AS player_count,"
    f" {ratio('SUM(winnings-stakes)', 'COUNT(winnings-stakes)')} AS avg_profit_loss,"
    f" {dbl('SUM(winnings-stakes)')} AS total_profit_loss"
    " FROM cash JOIN players USING (user_id) WHERE age_at_reg IS NOT NULL GROUP BY 1",
)
ORACLES["trd_revenue_by_country"] = sql(
    "cash players",
    f"SELECT {big('country_id')} AS country_id, COUNT(*) AS player_count,"
    f" {dbl('SUM(stakes-winnings)')} AS total_house_revenue,"
    f" {ratio('SUM(stakes-winnings)', 'COUNT(stakes-winnings)')} AS avg_revenue_per_player"
    " FROM cash JOIN players USING (user_id) WHERE country_id IS NOT NULL GROUP BY players.country_id"
    " ORDER BY 3 DESC, 1 LIMIT 15",
)
ORACLES["trd_game_preference"] = sql(
    "cash tourn",
    "SELECT kind AS player_type, COUNT(c)+COUNT(t)-COUNT(c+t) AS player_count FROM"
    " (SELECT CASE WHEN t.user_id IS NULL THEN 'Cash Games Only' WHEN c.user_id IS NULL THEN 'Tournaments Only'"
    " ELSE 'Both (Hybrid)' END AS kind, c.user_id AS c, t.user_id AS t"
    " FROM cash c FULL JOIN tourn t ON c.user_id=t.user_id) GROUP BY kind",
)
ORACLES["trd_session_size"] = sql(
    "cash_days",
    f"SELECT {ratio('SUM(windows)', 'COUNT(windows)', 1)} AS avg_windows_per_session,"
    f" {median('windows', 1)} AS median_windows, {big('MIN(windows)')} AS min_windows,"
    f" {big('MAX(windows)')} AS max_windows FROM cash_days",
)
ORACLES["trd_peak_weekdays"] = sql(
    "cash_days",
    "SELECT dayofweek(play_date) AS day_of_week, dayname(play_date) AS day_name,"
    f" COUNT(DISTINCT user_id) AS unique_players, {dbl('SUM(stakes)')} AS total_stakes FROM cash_days GROUP BY 1, 2",
)

# --- 8 funnels -----------------------------------------------------------------

_JOURNEY = """SELECT players.user_id, country_id, age_at_reg,
    CAST(in_dates.user_id IS NOT NULL AS INT) AS dep,
    CAST(cash.user_id IS NOT NULL AS INT) AS cash_play,
    CAST(cash.user_id IS NOT NULL OR tourn.user_id IS NOT NULL AS INT) AS play,
    CAST(COALESCE(cash.days,0)>1 OR COALESCE(tourn.days,0)>1 AS INT) AS again,
    CAST(out_dates.user_id IS NOT NULL AS INT) AS wd
    FROM players LEFT JOIN in_dates USING (user_id) LEFT JOIN out_dates USING (user_id)
    LEFT JOIN cash USING (user_id) LEFT JOIN tourn USING (user_id)"""
_JOURNEY_TABLES = "players in_dates out_dates cash tourn"
_STEPS = (
    ("Signed Up", "n", "n"),
    ("Made Deposit", "dep", "n"),
    ("Made First Play", "play", "dep"),
    ("Made Repeat Play", "again", "play"),
    ("Made Withdrawal", "wd", "again"),
)
ORACLES["fun_full"] = sql(
    _JOURNEY_TABLES,
    " UNION ALL ".join(
        f"SELECT '{label}' AS stage, {big(now)} AS count, {pct(now, 'n')} AS pct_of_signups,"
        f" {pct(now, before)} AS pct_of_prev_stage FROM counted"
        for label, now, before in _STEPS
    ),
    journey=_JOURNEY,
    counted="SELECT COUNT(*) AS n, SUM(dep) AS dep, SUM(play) AS play, SUM(again) AS again, SUM(wd) AS wd FROM journey",
)


def _conversion(key: str, label: str, played: str, rest: str) -> str:
    return sql(
        _JOURNEY_TABLES,
        f"SELECT {label} AS {key}, COUNT(*) AS signups, {big('SUM(dep)')} AS depositors, {big(f'SUM({played})')} AS players,"
        f" {pct('SUM(dep)', 'COUNT(*)')} AS deposit_conversion_pct,"
        f" {pct(f'SUM({played})', 'SUM(dep)')} AS play_conversion_pct FROM journey {rest}",
        journey=_JOURNEY,
    )


ORACLES["fun_by_country"] = _conversion(
    "country_id", big("journey.country_id"), "play", "WHERE country_id IS NOT NULL GROUP BY 1 HAVING COUNT(*)>=50"
)
ORACLES["fun_by_age"] = _conversion("age_group", _DECADE, "cash_play", "WHERE age_at_reg<55 GROUP BY 1")
ORACLES["fun_by_first_method"] = sql(
    "firsts cash",
    f"SELECT pay_method_cat, COUNT(*) AS depositors, COUNT(cash.user_id) AS players,"
    f" {pct('COUNT(cash.user_id)', 'COUNT(*)')} AS play_conversion_pct"
    " FROM firsts LEFT JOIN cash ON firsts.user_id=cash.user_id GROUP BY pay_method_cat HAVING COUNT(*)>=50",
)
ORACLES["fun_time_to_first_play"] = sql(
    "in_dates spans",
    "SELECT CASE WHEN d=0 THEN 'Same Day' WHEN d=1 THEN 'Next Day' WHEN d>1 AND d<8 THEN '2-7 Days'"
    " WHEN d>7 AND d<31 THEN '8-30 Days' ELSE '30+ Days' END AS time_to_first_play, COUNT(*) AS player_count,"
    f" {pct('COUNT(*)', '(SELECT COUNT(*) FROM waits)')} AS pct FROM waits GROUP BY 1",
    waits="SELECT DATE_DIFF('day', first_in, first_play) AS d FROM in_dates JOIN spans USING (user_id)",
)
ORACLES["fun_to_vip"] = sql(
    "players totals vips",
    " UNION ALL ".join(
        f"SELECT '{label}' AS stage, n AS count, {pct('n', _PEOPLE)} AS pct FROM (SELECT COUNT(*) AS n FROM {table})"
        for label, table in (("All Signups", "players"), ("Made Deposit", "totals"), ("Became VIP (Top 5%)", "vips"))
    ),
)
_DROPS = (("Signup → Deposit", "s", "d"), ("Deposit → Play", "d", "p"), ("Play → Withdraw", "p", "w"))
ORACLES["fun_dropoff"] = sql(
    "players in_dates out_dates spans",
    " UNION ALL ".join(
        f"SELECT '{label}' AS stage, {a} AS from_count, {b} AS to_count, {a}-{b} AS dropped,"
        f" {pct(f'{a}-{b}', a)} AS drop_rate_pct FROM counted"
        for label, a, b in _DROPS
    ),
    counted="SELECT (SELECT COUNT(*) FROM players) AS s, (SELECT COUNT(*) FROM in_dates) AS d,"
    " (SELECT COUNT(*) FROM spans) AS p, (SELECT COUNT(*) FROM out_dates) AS w",
)

# --- 9 windows -----------------------------------------------------------------

ORACLES["win_rank_deposits"] = sql(
    "totals",
    f"SELECT user_id, {dbl('total')} AS total_deposited, RANK() OVER d AS deposit_rank,"
    " DENSE_RANK() OVER d AS dense_rank, NTILE(10) OVER (ORDER BY total DESC, user_id) AS decile"
    " FROM totals WINDOW d AS (ORDER BY total DESC) ORDER BY totals.total DESC, user_id LIMIT 20",
)
ORACLES["win_rank_in_country"] = sql(
    "totals players",
    f"SELECT user_id, {big('country_id')} AS country_id, {dbl('total')} AS total_deposited,"
    " RANK() OVER (PARTITION BY players.country_id ORDER BY total DESC) AS rank_in_country"
    " FROM totals JOIN players USING (user_id) WHERE players.country_id IS NOT NULL AND total>0"
    " ORDER BY players.country_id, total DESC, user_id LIMIT 50",
)
_RUNNING = (
    f"SELECT user_id, process_date, {dbl('amount')} AS amount, {dbl('SUM(amount) OVER w')} AS running_total,"
    " COUNT(*) OVER w AS deposit_number FROM paid_in {where}"
    " WINDOW w AS (PARTITION BY user_id ORDER BY process_date, process_sec)"
)
ORACLES["win_running_total"] = sql(
    "paid_in",
    _RUNNING.format(
        where="WHERE user_id IN (SELECT user_id FROM deposits GROUP BY user_id HAVING COUNT(*)>=10"
        " ORDER BY user_id LIMIT 5)"
    ),
)
ORACLES["win_running_total_all"] = sql("paid_in", _RUNNING.format(where=""))
ORACLES["win_running_total_by_day"] = sql(
    "paid_in", _RUNNING.format(where="").replace("process_date, process_sec)", "process_date)")
)
_NEIGHBOUR = (
    "SELECT user_id, process_date, process_sec, deposit_id, amount, {f}(process_date) OVER"
    " (PARTITION BY user_id ORDER BY process_date, process_sec, deposit_id) AS other FROM paid_in"
)


def _neighbour(function: str, other: str, days: str) -> str:
    return sql(
        "paid_in",
        f"SELECT user_id, process_date, {dbl('amount')} AS amount, other AS {other},"
        f" abs(DATE_DIFF('day', other, process_date)) AS {days} FROM pairs WHERE DATE_DIFF('day', other, process_date) IS NOT NULL"
        " ORDER BY user_id, process_date, process_sec, deposit_id LIMIT 50",
        pairs=_NEIGHBOUR.format(f=function),
    )


ORACLES["win_days_since_prev"] = _neighbour("LAG", "prev_deposit_date", "days_since_prev")
ORACLES["win_days_to_next"] = _neighbour("LEAD", "next_deposit_date", "days_to_next")
ORACLES["win_avg_gap"] = sql(
    "paid_in",
    f"SELECT user_id, COUNT(*) AS num_gaps, {ratio('SUM(gap)', 'COUNT(*)', 1)} AS avg_days_between_deposits,"
    " MIN(gap) AS min_gap, MAX(gap) AS max_gap FROM gaps WHERE gap IS NOT NULL GROUP BY user_id HAVING COUNT(*)>=5"
    " ORDER BY avg_days_between_deposits, user_id LIMIT 20",
    pairs=_NEIGHBOUR.format(f="LAG"),
    gaps="SELECT user_id, DATE_DIFF('day', other, process_date) AS gap FROM pairs",
)
ORACLES["win_mom_deposits"] = sql(
    "month_in",
    f"SELECT month, {dbl('total')} AS monthly_total, {dbl('p')} AS prev_month_total, {dbl('total-p')} AS mom_change,"
    f" {pct('total-p', 'p')} AS mom_change_pct FROM (SELECT *, LAG(total) OVER (ORDER BY month) AS p FROM month_in)",
)
ORACLES["win_mom_ggr"] = sql(
    "month_ggr",
    f"SELECT month, {dbl('ggr')} AS ggr, {dbl('p')} AS prev_month_ggr, {dbl('ggr-p')} AS mom_change,"
    f" {pct('ggr-p', 'abs(p)')} AS mom_change_pct FROM (SELECT *, LAG(ggr) OVER (ORDER BY month) AS p FROM month_ggr)",
)
ORACLES["win_cumulative_deposits"] = sql(
    "month_in",
    f"SELECT month, {dbl('total')} AS monthly_total,"
    f" {dbl('SUM(total) OVER (ORDER BY month NULLS LAST)')} AS cumulative_deposits FROM month_in",
)
ORACLES["win_first_last_deposit"] = sql(
    "paid_in",
    "SELECT DISTINCT user_id, FIRST_VALUE(process_date) OVER w AS first_deposit_date,"
    f" {dbl('FIRST_VALUE(amount) OVER w')} AS first_deposit_amount, LAST_VALUE(process_date) OVER w AS last_deposit_date,"
    f" {dbl('LAST_VALUE(amount) OVER w')} AS last_deposit_amount FROM paid_in"
    " WINDOW w AS (PARTITION BY user_id ORDER BY process_date NULLS LAST, process_sec NULLS LAST, deposit_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ORDER BY user_id LIMIT 20",
)
ORACLES["win_moving_avg_ggr"] = sql(
    "month_ggr",
    f"SELECT month, {dbl('ggr')} AS ggr, {ratio('SUM(ggr) OVER w', 'COUNT(*) OVER w')} AS moving_avg_3m FROM month_ggr"
    " WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
ORACLES["win_pct_of_total"] = sql(
    "totals",
    f"SELECT user_id, {dbl('total')} AS total_deposited, {pct('total', 'w', 4)} AS pct_of_total,"
    f" {dbl('r')} AS running_total, {pct('r', 'w')} AS cumulative_pct FROM"
    " (SELECT *, SUM(total) OVER () AS w, SUM(total) OVER (ORDER BY total DESC) AS r FROM totals) s"
    " ORDER BY s.total DESC, user_id LIMIT 30",
)
ORACLES["win_first_record"] = sql(
    "firsts",
    f"SELECT user_id, deposit_id, process_date, {dbl('amount')} AS amount, pay_method_cat,"
    f" {big('1')} AS deposit_sequence FROM firsts ORDER BY user_id LIMIT 20",
)
