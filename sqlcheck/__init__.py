"""DuckDB SQL that answers each report on its own, for checking Spark's results."""

from sqlcheck.reports import ORACLES

__all__ = ["ORACLES"]
