"""Row counts, key uniqueness and allowed values: what a database would enforce, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wagerlens.functions.columns import count_if
from wagerlens.model import DOMAINS, KEYS, Tables


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def verify_row_counts(t: Tables) -> DataFrame:
    return _stack(
        [
            getattr(t, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
            for name in KEYS
        ]
    )


def key_report(df: DataFrame, table: str, key: tuple[str, ...]) -> DataFrame:
    """``duplicates``: key values held by more than one row; ``null_keys``: rows without a full key."""
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(count_if(~incomplete & (F.col("n") > 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(incomplete, F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"),
    ).select(
        F.lit(table).alias("tbl"),
        F.lit(",".join(key)).alias("key"),
        "duplicates",
        "null_keys",
    )


def check_keys(t: Tables) -> DataFrame:
    return _stack([key_report(getattr(t, name), name, key) for name, key in KEYS.items()])


def check_domains(t: Tables) -> DataFrame:
    """Rows whose code is outside the allowed values; NULL is counted apart."""
    return _stack(
        [
            getattr(t, name)
            .agg(
                F.coalesce(count_if(~F.col(column).isin(*allowed)), F.lit(0)).alias("bad_rows"),
                F.coalesce(count_if(F.col(column).isNull()), F.lit(0)).alias("null_rows"),
            )
            .select(F.lit(name).alias("tbl"), F.lit(column).alias("column_name"), "bad_rows", "null_rows")
            for name, column, allowed in DOMAINS
        ]
    )
