"""Player, play and payment analytics for gaming operators, on Spark DataFrames."""

from wagerlens.model import Tables

__all__ = ["Tables"]
