"""Every report against its SQL twin, value by value and type by type."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as driver
from tools.compare import difference, open_oracle
from wagerlens.sources.derived import DerivedTables

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF_DIR)


OURS = sorted(set(driver.queries()) - set(driver._training_data()[0]))


def test_every_report_has_a_twin():
    assert set(OURS) == set(driver.oracle_sql()) - set(driver._training_data()[1])


@pytest.mark.parametrize("name", OURS)
def test_report(spark, oracle, name):
    assert difference(driver.queries()[name](spark, SF_DIR), oracle, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 7


def test_derived_tables_keep_every_given_row(spark):
    folder = "/root/testdata/sf0.01"
    t = DerivedTables(spark, folder)
    count = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").count()
    assert t.players.count() == count("customer")
    assert t.deposits.count() + t.withdrawals.count() == count("orders")
    lines = count("lineitem")
    assert t._plays().count() == lines
    entries = t.tourn_days.agg({"entries": "sum"}).first()[0]
    assert entries == t._plays().filter("game_type = 'Tournaments'").count() < lines
    known = t.players.select("user_id")
    assert not t.deposits.join(known, "user_id", "left_anti").isEmpty()
    assert not known.join(t.play_days, "user_id", "left_anti").isEmpty()


def test_checks_have_something_to_find(spark):
    found = {r.tbl: r.duplicates for r in driver.queries()["check_keys"](spark, "/root/testdata/sf0.01").collect()}
    assert found["deposits"] > 0 or found["withdrawals"] > 0
    assert all(r.bad_rows > 0 for r in driver.queries()["check_domains"](spark, "/root/testdata/sf0.01").collect())
