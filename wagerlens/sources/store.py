"""The cleaned tables as Parquet: load, top up, query many times.

A table is a folder of parts: ``load`` from the full load, one more for each batch that was
ingested. A part is written whole, and again if its job is repeated, so no row is lost or
doubled whichever job wrote it. Ingested parts count once they are in the table's record, beside the files that they hold; what an
ingest left unfinished is not read. Rows that do not parse go to ``_bad/<table>`` in the same
parts, when a load is asked to be tolerant. Facts are sorted by date within each file, so that a filter on dates skips most of it.

The facts are not bucketed by player. Every per-player question pre-aggregates
before its shuffle, so a player who owns a third of all rows costs a few partial
rows per task; one bucket per player hash would put those rows in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from wagerlens.model import SCHEMAS, Tables
from wagerlens.sources.cleaning import CLEANERS, split_bad_rows
from wagerlens.sources.text import raw_schema, read_table

LOAD = "load"
RECORD_SCHEMA = StructType([StructField(name, StringType()) for name in ("part", "file", "digest")])
#: The column by which the rows of a file are sorted.
SORTED_BY = {"players": "user_id", "cash_days": "play_date", "tourn_days": "play_date", "deposits": "process_date", "withdrawals": "process_date"}


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(folder) if system.exists(folder) else []
    return sorted(status.getPath().getName() for status in found if status.isDirectory())


def record_folder(store_dir: str, table: str) -> str:
    return f"{store_dir}/_record/{table}"


def record_of(spark: SparkSession, store_dir: str, table: str) -> DataFrame:
    """(part, file, digest) of the files that were ingested into a table."""
    if table not in _folders(spark, f"{store_dir}/_record"):
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.schema(RECORD_SCHEMA).parquet(record_folder(store_dir, table))


def parts_of(spark: SparkSession, store_dir: str, table: str, below: str = "") -> list[str]:
    """The folders of a table's parts that count: the full load, and what is recorded. ``below`` is the folder of rows set aside."""
    found = _folders(spark, f"{store_dir}/{below}{table}")
    if unknown := [name for name in found if name != LOAD and not name.startswith("files-")]:
        raise ValueError(f"{table} has parts that no record can tell of: {unknown[:3]}; load the store anew")
    recorded = {row.part for row in record_of(spark, store_dir, table).select("part").distinct().collect()}
    return [f"{store_dir}/{below}{table}/{name}" for name in found if name == LOAD or name in recorded]


def write_part(raw: DataFrame, table: str, store_dir: str, part: str, tolerant: bool = False) -> None:
    """Clean raw rows into one part of a stored table; with ``tolerant``, set aside the rows that do not parse."""
    if tolerant:
        good, bad = split_bad_rows(raw, table)
        bad.write.mode("overwrite").parquet(f"{store_dir}/_bad/{table}/{part}")
    else:
        good = CLEANERS[table](raw)
    good.sortWithinPartitions(SORTED_BY[table]).write.mode("overwrite").parquet(f"{store_dir}/{table}/{part}")


def prepare(spark: SparkSession, raw_dir: str, store_dir: str, tolerant: bool = False) -> None:
    """Text files ``raw_dir/<table>.csv`` to the store, map-only. A second load replaces the first, not what was ingested."""
    for table in CLEANERS:
        write_part(read_table(spark, table, f"{raw_dir}/{table}.csv"), table, store_dir, LOAD, tolerant)


def _read(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, store_dir: str) -> Tables:
    """Open a store. The schema is given, so no footers are read to infer it; a table that was never loaded is empty."""
    return Tables(**{name: _read(spark, schema, parts_of(spark, store_dir, name)) for name, schema in SCHEMAS.items()})


def bad_rows(spark: SparkSession, store_dir: str, table: str) -> DataFrame:
    """The raw rows of a table that tolerant loads set aside; none if there was no such load."""
    return _read(spark, raw_schema(table), parts_of(spark, store_dir, table, "_bad/"))
