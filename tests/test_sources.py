"""Reading, cleaning, checking, storing and exporting."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

import pytest

from wagerlens.model import SCHEMAS
from wagerlens.operators.financial import fin_total_ggr
from wagerlens.operators.payments import pay_peak_hours
from wagerlens.sources.checks import check_domains, check_keys, verify_row_counts
from wagerlens.sources.cleaning import clean_all, clean_deposits, clean_players, split_bad_rows
from wagerlens.sources.store import LOAD, bad_rows, load, prepare, write_part
from wagerlens.sources.text import RAW_COLUMNS, export_result, raw_schema, read_table
from wagerlens.streaming.ingest import ingest_new_files

FILES = {
    "players": ["1,34,M,40", "2,,F,", "3,19,,276"],
    "cash_days": ["1,2015-02-01,3,100.50,90.25", "2,2015-02-03,1,10,12"],
    "tourn_days": ["1,2015-02-02,2,1.23456,0.5"],
    "deposits": [
        "1,11,2015-02-01,2015-02-01,23:59:59,Visa,Cards,debit,25.00,S",
        "1,12,2015-02-01,2015-02-02,00:00:01,Visa,Cards,debit,30.00,F",
    ],
    "withdrawals": ["1,21,2015-02-05,2015-02-06,08:00:00,Visa,Cards,debit,5.10,R"],
}


@pytest.fixture
def raw_dir(tmp_path):
    for table, lines in FILES.items():
        (tmp_path / f"{table}.csv").write_text("\n".join([",".join(RAW_COLUMNS[table]), *lines]) + "\n")
    return str(tmp_path)


def test_prepare_and_load(spark, raw_dir, tmp_path, rows):
    prepare(spark, raw_dir, str(tmp_path / "store"))
    t = load(spark, str(tmp_path / "store"))
    for name, schema in SCHEMAS.items():
        assert [(f.name, f.dataType) for f in getattr(t, name).schema] == [(f.name, f.dataType) for f in schema]
    assert rows(verify_row_counts(t)) == [
        ("players", 3),
        ("cash_days", 2),
        ("tourn_days", 1),
        ("deposits", 2),
        ("withdrawals", 1),
    ]
    assert rows(t.players.orderBy("user_id")) == [(1, 34, "M", 40), (2, None, "F", None), (3, 19, None, 276)]
    first = t.deposits.filter("deposit_id = 11").first()
    assert (first.process_ts, first.amount) == (dt.datetime(2015, 2, 1, 23, 59, 59), Decimal("25.00"))
    assert rows(pay_peak_hours(t)) == [(23, 1, 25.0), (0, 1, 0.0)]
    assert rows(fin_total_ggr(t))[1][:3] == ("Tournaments", 1.23456, 0.5)
    assert clean_all({n: read_table(spark, n, f"{raw_dir}/{n}.csv") for n in FILES}).deposits.count() == 2


def test_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "players.csv").write_text("UserID,Gender,SystemAgeAsOfReg,CountryID\n1,M,34,40\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_table(spark, "players", str(tmp_path / "players.csv")).collect()


def test_strict_cleaning_fails_on_bad_text(spark):
    raw = spark.createDataFrame([("1", "old", "M", "40")], raw_schema("players"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean_players(raw).collect()


def test_blank_is_null_only_where_it_means_unknown(spark):
    blank = spark.createDataFrame([("1", "", "", "")], raw_schema("players"))
    assert tuple(clean_players(blank).first()) == (1, None, None, None)
    line = ("1", "5", "2015-02-01", "2015-02-01", "10:00:00", "", "", "", "", "S")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean_deposits(spark.createDataFrame([line], raw_schema("deposits"))).collect()


def test_bad_rows_are_split_off_whole(spark):
    lines = [
        ("1", "34", "M", "40"),
        ("2", "", "F", "40"),
        ("x", "34", "M", "40"),
        (None, "34", "M", "40"),
        ("3", "34", "M", "Spain"),
    ]
    good, bad = split_bad_rows(spark.createDataFrame(lines, raw_schema("players")), "players")
    assert sorted(r.user_id for r in good.collect()) == [1, 2]
    assert sorted((r.UserID or "", r.CountryID) for r in bad.collect()) == [("", "40"), ("3", "Spain"), ("x", "40")]


def test_key_and_domain_checks(tables, rows):
    t = tables(
        players=[(1, 30, "M", 1), (1, 31, "X", 1), (2, 30, None, 1)],
        cash=[(1, "2020-01-01", 1, 1, 1)] * 3 + [(1, "2020-01-02", 1, 1, 1)],
        deposits=[(1, "2020-01-01", 1, "S", "Cards", 7), (2, "2020-01-01", 1, "R", "Cards", 7)],
        withdrawals=[(1, "2020-01-01", 1, "F")],
    )
    t.players = t.players.unionByName(t.players.limit(1).selectExpr("cast(null as long) user_id", "age_at_reg", "gender", "country_id"))
    assert rows(check_keys(t), "tbl", "duplicates", "null_keys") == [
        ("players", 1, 1),
        ("cash_days", 1, 0),
        ("tourn_days", 0, 0),
        ("deposits", 1, 0),
        ("withdrawals", 0, 0),
    ]
    assert rows(check_domains(t), "tbl", "bad_rows")[1:] == [("deposits", 1), ("withdrawals", 1)]


def test_export_has_a_header_and_keeps_order(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS user_id", "id * 2 AS total").orderBy("user_id", ascending=False)
    export_result(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    lines = [part.read_text().splitlines() for part in parts]
    assert all(line[0] == "user_id,total" for line in lines)
    assert [int(row.split(",")[0]) for line in lines for row in line[1:]] == list(range(99, -1, -1))


def test_ingest_takes_each_file_once(spark, tmp_path):
    # the checkpoint folder may outlive the test's own, so the store gets a name never used before
    landing, store = tmp_path / "landing", str(tmp_path / f"store-{uuid.uuid4().hex}")
    landing.mkdir()
    header = ",".join(RAW_COLUMNS["players"])
    read = lambda: sorted(r.user_id for r in spark.read.schema(SCHEMAS["players"]).parquet(f"{store}/players/*").collect())

    (landing / "a.csv").write_text(f"{header}\n1,34,M,40\n2,,F,\n")
    ingest_new_files(spark, "players", str(landing), store).awaitTermination()
    assert read() == [1, 2]
    (landing / "b.csv").write_text(f"{header}\n3,19,M,276\n")
    ingest_new_files(spark, "players", str(landing), store).awaitTermination()
    assert read() == [1, 2, 3]


def test_load_and_report_jobs(spark, raw_dir, tmp_path):
    from wagerlens.__main__ import main

    store, out = str(tmp_path / "store"), tmp_path / "out"
    main(["load", raw_dir, store])
    main(["report", store, str(out), "fin_total_ggr", "acq_gender"])
    assert sorted(p.parent.name + "/" + p.name for p in out.glob("*/*")) == [
        "01_financial_performance/fin_total_ggr",
        "02_player_acquisition/acq_gender",
    ]
    text = "".join(p.read_text() for p in (out / "01_financial_performance/fin_total_ggr").glob("part-*"))
    assert text.splitlines()[:2] == [
        "game_type,total_stakes,total_winnings,ggr,hold_pct",
        "Cash Games,110.50000,102.25000,8.25000,7.47",
    ]
    with pytest.raises(ValueError, match="no such report: nothing"):
        main(["report", store, str(out), "nothing"])


def _store(tmp_path):
    return str(tmp_path / f"store-{uuid.uuid4().hex}")


def test_a_store_can_be_loaded_and_topped_up(spark, raw_dir, tmp_path):
    store, landing = _store(tmp_path), tmp_path / "landing"
    landing.mkdir()
    prepare(spark, raw_dir, store)
    before = load(spark, store).players.count()
    header = ",".join(RAW_COLUMNS["players"])
    for k, name in enumerate("ab"):
        (landing / f"{name}.csv").write_text(f"{header}\n{9000 + k},34,M,40\n")
        ingest_new_files(spark, "players", str(landing), store).awaitTermination()
        assert load(spark, store).players.count() == before + k + 1
    prepare(spark, raw_dir, store)  # a second load replaces the first
    assert load(spark, store).players.count() == before + 2


def test_a_repeated_batch_is_not_doubled(spark, tmp_path):
    store = _store(tmp_path)
    raw = spark.createDataFrame([("1", "34", "M", "40")], raw_schema("players"))
    for _ in range(2):
        write_part(raw, "players", store, "batch-000000000")
    assert spark.read.parquet(f"{store}/players/*").count() == 1


def _land(landing, **files):
    landing.mkdir(exist_ok=True)
    for name, line in files.items():
        (landing / f"{name}.csv").write_text(",".join(RAW_COLUMNS["players"]) + f"\n{line}\n")


def test_ingest_under_another_checkpoint(spark, tmp_path, monkeypatch):
    """Neither another shared folder nor a lost checkpoint loses or doubles a row; files that go together differently count once."""
    store, landing = _store(tmp_path), tmp_path / "landing"
    ids = lambda: sorted(r.user_id for r in load(spark, store).players.collect())
    monkeypatch.setattr("wagerlens.streaming.ingest.checkpoint_folder", lambda store_dir, table: str(tmp_path / f"checkpoint-{uuid.uuid4().hex}"))
    _land(landing, a="1,34,M,40\n2,,F,")
    ingest_new_files(spark, "players", str(landing), store).awaitTermination()
    _land(landing, b="3,19,M,276")
    for _ in range(2):  # each run sees all files
        ingest_new_files(spark, "players", str(landing), store).awaitTermination()
        assert ids() == [1, 2, 3]
    _land(landing, b="4,19,M,276", c="3,19,M,276")  # a file with other rows and an old file's rows under another name are new files
    ingest_new_files(spark, "players", str(landing), store).awaitTermination()
    assert ids() == [1, 2, 3, 3, 4]


def test_an_unfinished_batch_is_not_read(spark, tmp_path, monkeypatch):
    """A part without a record counts for nothing; the next run takes its files in, whatever comes with them."""
    store, landing = _store(tmp_path), tmp_path / "landing"
    _land(landing, a="1,34,M,40")
    with monkeypatch.context() as patch:
        patch.setattr("wagerlens.streaming.ingest.record_folder", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            ingest_new_files(spark, "players", str(landing), store).awaitTermination()
    assert spark.read.parquet(f"{store}/players/*").count() == 1 and load(spark, store).players.count() == 0
    _land(landing, b="2,34,M,40")
    monkeypatch.setattr("wagerlens.streaming.ingest.checkpoint_folder", lambda *_: str(tmp_path / "other"))
    ingest_new_files(spark, "players", str(landing), store).awaitTermination()
    assert sorted(r.user_id for r in load(spark, store).players.collect()) == [1, 2]


def test_a_store_with_empty_tables_and_foreign_parts(spark, tmp_path, rows):
    from wagerlens.plans.catalog import REPORTS

    store = _store(tmp_path)
    write_part(spark.createDataFrame([("1", "34", "M", "40")], raw_schema("players")), "players", store, LOAD)
    t = load(spark, store)
    assert [getattr(t, name).count() for name in SCHEMAS] == [1, 0, 0, 0, 0]
    assert rows(REPORTS["acq_player_count"](t)) and REPORTS["risk_composite_score"](t).count() == 0
    write_part(spark.createDataFrame([("1", "34", "M", "40")], raw_schema("players")), "players", store, "batch-000000000")
    with pytest.raises(ValueError, match="load the store anew"):
        load(spark, store)


def test_parts_are_sorted_by_date(spark, tmp_path):
    store = _store(tmp_path)
    raw = spark.range(3000).selectExpr("string(id % 7)", "string(date_add(date'2015-01-01', int(id * 37 % 400)))", "'1'", "'1.00'", "'0.50'").toDF(*RAW_COLUMNS["cash_days"])
    write_part(raw, "cash_days", store, LOAD)
    for file in (tmp_path / store.rsplit("/")[-1]).rglob("*.parquet"):
        days = [r.play_date for r in spark.read.parquet(str(file)).collect()]
        assert days == sorted(days)


def test_ingest_refuses_a_swapped_header(spark, tmp_path):
    store, landing = _store(tmp_path), tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("UserID,CountryID,Gender,SystemAgeAsOfReg\n5,276,M,33\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        ingest_new_files(spark, "players", str(landing), store).awaitTermination()


def test_tolerant_jobs_set_bad_rows_aside(spark, tmp_path, capsys):
    from wagerlens.__main__ import main

    store, landing = _store(tmp_path), tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(",".join(RAW_COLUMNS["players"]) + "\n1,34,M,40\nx,34,M,40\n2,old,M,40\n")
    main(["ingest", "players", str(landing), store, "--tolerant"])
    assert spark.read.parquet(f"{store}/players/*").count() == 1
    assert sorted(r.UserID for r in bad_rows(spark, store, "players").collect()) == ["2", "x"]
    assert "players: 2 rows set aside" in capsys.readouterr().out


def test_strict_cleaning_refuses_a_missing_owner(spark):
    row = {name: None for name in RAW_COLUMNS["deposits"]} | {"DepositID": "5", "Amount": "1.00", "Status": "S"}
    raw = spark.createDataFrame([tuple(row.values())], raw_schema("deposits"))
    with pytest.raises(Exception, match="user_id is missing"):
        clean_deposits(raw).collect()
