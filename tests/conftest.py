from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql.types import DateType, DecimalType, StructType, TimestampNTZType  # noqa: E402

from wagerlens.model import SCHEMAS, Tables  # noqa: E402
from wagerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", app="tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def _value(text, kind):
    if text is None:
        return None
    if isinstance(kind, DecimalType):
        return Decimal(str(text))
    if isinstance(kind, DateType) and isinstance(text, str):
        return dt.date.fromisoformat(text)
    if isinstance(kind, TimestampNTZType) and isinstance(text, str):
        return dt.datetime.fromisoformat(text)
    return text


def _transaction(id_name, row):
    """(user, 'YYYY-MM-DD[ HH:MM:SS]', amount, status[, category[, id]]) with defaults for the rest."""
    user, moment, amount, status, *rest = row
    stamp = dt.datetime.fromisoformat(moment)
    category = rest[0] if rest else "Cards"
    return {
        "user_id": user,
        "summary_date": stamp.date(),
        "process_date": stamp.date(),
        "process_ts": stamp,
        "pay_method": None,
        "pay_method_cat": category,
        "card_type": None,
        "amount": amount,
        "status": status,
    } | ({id_name: rest[1]} if len(rest) > 1 else {})


@pytest.fixture
def tables(spark):
    """Build the five tables from short tuples; missing ones are empty."""

    def build(players=(), cash=(), tourn=(), deposits=(), withdrawals=()) -> Tables:
        def frame(name, rows):
            schema: StructType = SCHEMAS[name]
            ready = [
                tuple(_value(row[f.name] if isinstance(row, dict) else row[i], f.dataType) for i, f in enumerate(schema))
                for row in rows
            ]
            return spark.createDataFrame(ready, schema)

        def transactions(name, id_name, rows):
            return frame(name, [{id_name: i + 1} | _transaction(id_name, row) for i, row in enumerate(rows)])

        return Tables(
            players=frame("players", players),
            cash_days=frame("cash_days", cash),
            tourn_days=frame("tourn_days", tourn),
            deposits=transactions("deposits", "deposit_id", deposits),
            withdrawals=transactions("withdrawals", "withdrawal_id", withdrawals),
        )

    return build


@pytest.fixture
def rows():
    """A result as tuples, decimals as floats."""

    def read(df, *columns):
        chosen = df.select(*columns) if columns else df
        return [tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in chosen.collect()]

    return read
