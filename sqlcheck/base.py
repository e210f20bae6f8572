"""The five derived tables in DuckDB SQL, put before a query as a WITH clause."""

from __future__ import annotations

_SPAN = (
    "(CASE o_custkey%8 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 28 WHEN 3 THEN 85"
    " WHEN 4 THEN 170 WHEN 5 THEN 360 ELSE 1500 END)"
)


def _day(date: str, shift: str) -> str:
    offset = f"DATE_DIFF('day', DATE '1995-01-01', CAST({date} AS DATE)) % ({_SPAN}+1)"
    return f"(DATE '1995-01-01' + CAST((o_custkey*13)%900 + {shift} + {offset} AS INT))"


def _cents(units: str) -> str:
    return f"CAST(CAST({units} AS DECIMAL(18,0))*CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


_USER = "CASE WHEN o_custkey%211=0 THEN o_custkey+1000000000000 ELSE o_custkey END"
_IS_WITHDRAWAL = "((o_orderkey%5=0 AND o_custkey%3<>0) OR o_custkey%11=0)"


def _transactions(id_name: str, keep: str, shift: str, divisor: str, lost: str) -> str:
    amount = _cents(f"CAST(ROUND(o_totalprice*100) AS BIGINT) // ({divisor})")
    return f"""SELECT CASE WHEN o_orderkey%1009=0 THEN o_orderkey-1 ELSE o_orderkey END AS {id_name},
        {_USER} AS user_id,
        CASE WHEN o_orderkey%109<>0 THEN {_day("o_orderdate", shift)} END AS process_date,
        CASE WHEN o_orderkey%101<>0 AND o_orderkey%109<>0 THEN (o_orderkey*7919)%86400 END AS process_sec,
        'method ' || (o_orderkey%3) AS pay_method,
        CASE WHEN o_orderkey%113<>0 THEN o_orderpriority END AS pay_method_cat,
        CASE WHEN o_orderkey%4<>0 THEN 'card ' || (o_orderkey%5) END AS card_type,
        CASE WHEN o_orderkey%107<>0 THEN {amount} END AS amount,
        CASE WHEN o_orderkey%499=0 THEN 'X' WHEN o_orderstatus='F' THEN '{lost}' ELSE 'S' END AS status
    FROM orders WHERE {keep}"""


def _play_days(units: str, name: str, keep: str) -> str:
    return f"""SELECT user_id, play_date, CAST({units} AS BIGINT) AS {name},
        {_cents("SUM(stake_c)")} AS stakes, {_cents("SUM(win_c)")} AS winnings
    FROM plays WHERE {keep} GROUP BY user_id, play_date"""


_PLAY_SHIFT = "(CASE o_custkey%6 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END)*(1+o_custkey%9)"

TABLES = {
    "players": """SELECT c_custkey AS user_id,
        CASE WHEN c_custkey%97<>0 THEN CAST(18+(c_custkey*37)%53 AS INT) END AS age_at_reg,
        CASE WHEN c_custkey%101=0 THEN NULL WHEN c_custkey%10=0 THEN 'F' WHEN c_custkey%103=0 THEN 'X' ELSE 'M' END
            AS gender,
        c_nationkey AS country_id
    FROM customer""",
    "deposits": _transactions(
        "deposit_id", f"NOT {_IS_WITHDRAWAL}", "0", "100*(1+o_custkey%40)*(1+o_orderkey%9)", "F"
    ),
    "withdrawals": _transactions(
        "withdrawal_id", _IS_WITHDRAWAL, "(o_custkey%5)*2", "100*(2+o_custkey%40)", "R"
    ),
    "plays": f"""SELECT {_USER} AS user_id, {_day("l_shipdate", _PLAY_SHIFT)} AS play_date,
        CASE WHEN (l_linestatus='F' AND o_custkey%5<>0) OR o_custkey%7=0 THEN 'T' ELSE 'C' END AS game,
        CAST(l_quantity AS INT) AS qty,
        CASE WHEN o_custkey%83<>0 THEN CAST(ROUND(l_extendedprice*100) AS BIGINT)//1000 END AS stake_c,
        CASE WHEN o_custkey%53=0 THEN CAST(ROUND(l_extendedprice*100) AS BIGINT)//1000
            WHEN o_custkey%89<>0 THEN (CAST(ROUND(l_extendedprice*100) AS BIGINT)
            *(10*CAST(ROUND(l_discount*100) AS BIGINT)+6*CAST(ROUND(l_tax*100) AS BIGINT))
            *(7+o_custkey%10))//1000000 END AS win_c
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "cash_days": _play_days("SUM(qty)", "windows", "game='C'"),
    "tourn_days": _play_days("COUNT(*)", "entries", "game='T'"),
    "play_days": """SELECT 'Cash Games' AS game_type, user_id, play_date, stakes, winnings FROM cash_days
        UNION ALL SELECT 'Tournaments', user_id, play_date, stakes, winnings FROM tourn_days""",
    # shared steps
    "paid_in": "SELECT * FROM deposits WHERE status='S'",
    "paid_out": "SELECT * FROM withdrawals WHERE status='S'",
    "totals": "SELECT user_id, COUNT(*) AS deposit_count, SUM(amount) AS total FROM paid_in GROUP BY user_id",
    "cut": "SELECT quantile_cont(CAST(total AS DOUBLE), 0.95) AS p95 FROM totals",
    "vips": "SELECT user_id, total FROM totals, cut WHERE CAST(total AS DOUBLE) >= p95",
    "firsts": """SELECT * FROM paid_in
        QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY process_date, process_sec, deposit_id) = 1""",
    "in_dates": "SELECT user_id, MIN(process_date) AS first_in FROM paid_in GROUP BY user_id",
    "out_dates": "SELECT user_id, MIN(process_date) AS first_out FROM paid_out GROUP BY user_id",
    "spans": """SELECT user_id, MIN(play_date) AS first_play, MAX(play_date) AS last_play,
        DATE_DIFF('day', MIN(play_date), MAX(play_date)) AS days FROM play_days GROUP BY user_id""",
    "cash": """SELECT user_id, SUM(stakes) AS stakes, SUM(winnings) AS winnings, COUNT(*) AS days
        FROM cash_days GROUP BY user_id""",
    "tourn": """SELECT user_id, SUM(stakes) AS stakes, SUM(winnings) AS winnings, COUNT(*) AS days
        FROM tourn_days GROUP BY user_id""",
    "month_in": "SELECT CAST(date_trunc('month', process_date) AS DATE) AS month, SUM(amount) AS total"
    " FROM paid_in GROUP BY 1",
    "month_ggr": "SELECT CAST(date_trunc('month', play_date) AS DATE) AS month,"
    " SUM(stakes) AS stakes, SUM(winnings) AS winnings, SUM(stakes)-SUM(winnings) AS ggr FROM cash_days GROUP BY 1",
}
_NEEDS = {
    "cash_days": ["plays"],
    "tourn_days": ["plays"],
    "play_days": ["cash_days", "tourn_days"],
    "paid_in": ["deposits"],
    "paid_out": ["withdrawals"],
    "totals": ["paid_in"],
    "cut": ["totals"],
    "vips": ["cut"],
    "firsts": ["paid_in"],
    "in_dates": ["paid_in"],
    "out_dates": ["paid_out"],
    "spans": ["play_days"],
    "cash": ["cash_days"],
    "tourn": ["tourn_days"],
    "month_in": ["paid_in"],
    "month_ggr": ["cash_days"],
}


def sql(tables: str, select: str, **steps: str) -> str:
    """``select`` over the named tables, then any extra steps in the order given."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in tables.split():
        need(name)
    parts = [f"{name} AS ({TABLES[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


# A quotient that lies on a rounding limit in decimals may lie a hair below it as a DOUBLE. Other quotients of
# cents and counts are further from a limit than this lifts them.
_TO_LIMIT = "(1+1e-12)"


def pct(n: str, d: str, places: int = 2) -> str:
    return f"CAST(ROUND(100.0*({n})/NULLIF({d},0)*{_TO_LIMIT}, {places}) AS DOUBLE)"


def ratio(n: str, d: str, places: int = 2) -> str:
    return f"CAST(ROUND(1.0*({n})/NULLIF({d},0)*{_TO_LIMIT}, {places}) AS DOUBLE)"


def median(value: str, places: int) -> str:
    exact = f"CAST(quantile_cont(CAST({value} AS DOUBLE), 0.5) AS DECIMAL(20,6))"
    return f"CAST(ROUND({exact}, {places}) AS DOUBLE)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def month(value: str) -> str:
    return f"CAST(date_trunc('month', {value}) AS DATE)"
