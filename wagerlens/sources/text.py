"""The all-text files the tables arrive in, and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

_PAYMENT = ["SummaryDate", "ProcessDate", "ProcessTime", "PayMethod", "PayMethCat", "CardType", "Amount", "Status"]

# The column names of the raw files, in file order.
RAW_COLUMNS: dict[str, list[str]] = {
    "players": ["UserID", "SystemAgeAsOfReg", "Gender", "CountryID"],
    "cash_days": ["UserID", "Date", "Windows", "StakesC", "WinningsC"],
    "tourn_days": ["UserID", "Date", "Trnmnts", "StakesT", "WinningsT"],
    "deposits": ["UserID", "DepositID", *_PAYMENT],
    "withdrawals": ["UserID", "WithdrawalID", *_PAYMENT],
}


def raw_schema(table: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in RAW_COLUMNS[table]])


# One definition for batch and stream: a header that does not match the columns is refused.
CSV_OPTIONS = {"header": True, "enforceSchema": False}


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Read one raw table as text: fixed columns, no inference pass over the data."""
    return spark.read.schema(raw_schema(table)).options(**CSV_OPTIONS).csv(path)


def stream_table(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """The same for files that arrive in a folder."""
    return spark.readStream.schema(raw_schema(table)).options(**CSV_OPTIONS).csv(folder)


def export_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result with a header, one file per task.

    Rows keep the order of an ``orderBy`` across the numbered part files, and no
    result is squeezed through a single task.
    """
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)
