"""From all-text frames to typed tables.

``clean_*`` is strict: text that does not parse fails the job, as a column type
change does in a database, and so does a missing key or player. ``split_bad_rows`` is the tolerant path for feeds with
damaged rows; it keeps every row, on one side or the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField

from wagerlens.model import SCHEMAS, Tables

# ours -> raw file column, or the pair (date, time of day) for a timestamp
_PAYMENT_COLUMNS = {
    "user_id": "UserID",
    "summary_date": "SummaryDate",
    "process_date": "ProcessDate",
    "process_ts": ("ProcessDate", "ProcessTime"),
    "pay_method": "PayMethod",
    "pay_method_cat": "PayMethCat",
    "card_type": "CardType",
    "amount": "Amount",
    "status": "Status",
}
COLUMN_SOURCES: dict[str, dict[str, str | tuple[str, str]]] = {
    "players": {
        "user_id": "UserID",
        "age_at_reg": "SystemAgeAsOfReg",
        "gender": "Gender",
        "country_id": "CountryID",
    },
    "cash_days": {
        "user_id": "UserID",
        "play_date": "Date",
        "windows": "Windows",
        "stakes": "StakesC",
        "winnings": "WinningsC",
    },
    "tourn_days": {
        "user_id": "UserID",
        "play_date": "Date",
        "entries": "Trnmnts",
        "stakes": "StakesT",
        "winnings": "WinningsT",
    },
    "deposits": {"deposit_id": "DepositID", **_PAYMENT_COLUMNS},
    "withdrawals": {"withdrawal_id": "WithdrawalID", **_PAYMENT_COLUMNS},
}
# Columns in which blank text means "not known". The files' own cleaning says so of age and country; a blank
# gender is taken the same way.
BLANK_IS_NULL = {"age_at_reg", "gender", "country_id"}


def _text(name: str, source: str | tuple[str, str]) -> Column:
    if isinstance(source, tuple):
        date, time = source
        return F.concat(F.col(date), F.lit(" "), F.col(time))
    column = F.col(source)
    return F.nullif(column, F.lit("")) if name in BLANK_IS_NULL else column


def _clean(raw: DataFrame, table: str) -> DataFrame:
    def typed(field: StructField) -> Column:
        value = _text(field.name, COLUMN_SOURCES[table][field.name]).cast(field.dataType)
        if not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{table}: {field.name} is missing")).cast(field.dataType))
        return value.alias(field.name)

    return raw.select(*[typed(field) for field in SCHEMAS[table].fields])


def clean_players(raw: DataFrame) -> DataFrame:
    return _clean(raw, "players")


def clean_cash(raw: DataFrame) -> DataFrame:
    return _clean(raw, "cash_days")


def clean_tournaments(raw: DataFrame) -> DataFrame:
    return _clean(raw, "tourn_days")


def clean_deposits(raw: DataFrame) -> DataFrame:
    return _clean(raw, "deposits")


def clean_withdrawals(raw: DataFrame) -> DataFrame:
    return _clean(raw, "withdrawals")


CLEANERS = {
    "players": clean_players,
    "cash_days": clean_cash,
    "tourn_days": clean_tournaments,
    "deposits": clean_deposits,
    "withdrawals": clean_withdrawals,
}


def clean_all(raw: dict[str, DataFrame]) -> Tables:
    return Tables(**{table: CLEANERS[table](frame) for table, frame in raw.items()})


def split_bad_rows(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Return ``(typed rows, raw rows that do not parse)``."""
    failures = []
    typed = []
    for field in SCHEMAS[table].fields:
        text = _text(field.name, COLUMN_SOURCES[table][field.name])
        value = text.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        failures.append(text.isNotNull() & value.isNull())
        if not field.nullable:
            failures.append(text.isNull())
    bad = reduce(lambda a, b: a | b, failures)
    return raw.filter(~bad).select(*typed), raw.filter(bad)
