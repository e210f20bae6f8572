"""Ordered label bands: the first matching band wins, NULL and the rest take ``otherwise``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Bands:
    bands: tuple[tuple[str, Callable[[Column], Column]], ...]
    otherwise: str

    def label(self, value: Column) -> Column:
        return self._pick(value, [name for name, _ in self.bands], self.otherwise)

    def position(self, value: Column) -> Column:
        return self._pick(value, range(1, len(self.bands) + 1), len(self.bands) + 1)

    def before(self, name: str, test: Callable[[Column], Column]) -> "Bands":
        """The same bands with one more in front."""
        return replace(self, bands=((name, test), *self.bands))

    def _pick(self, value, outputs, otherwise):
        chosen = F
        for (_, test), output in zip(self.bands, outputs):
            chosen = chosen.when(test(value), F.lit(output))
        return chosen.otherwise(F.lit(otherwise))


# Band labels and limits.
AGE_AT_SIGNUP = Bands(
    (
        ("Under 21", lambda age: age < 21),
        ("21-25", lambda age: age <= 25),
        ("26-30", lambda age: age <= 30),
        ("31-35", lambda age: age <= 35),
        ("36-40", lambda age: age <= 40),
        ("41-45", lambda age: age <= 45),
        ("46-55", lambda age: age <= 55),
        ("55+", lambda age: age > 55),
    ),
    otherwise="Unknown",
)
AGE_DECADE = Bands(
    (
        ("Under 25", lambda age: age < 25),
        ("25-34", lambda age: age <= 34),
        ("35-44", lambda age: age <= 44),
        ("45-54", lambda age: age <= 54),
    ),
    otherwise="55+",
)
LIFESPAN = Bands(
    (
        ("1 day only", lambda days: days == 0),
        ("2-7 days", lambda days: days.between(1, 7)),
        ("8-30 days", lambda days: days.between(8, 30)),
        ("1-3 months", lambda days: days.between(31, 90)),
        ("3-6 months", lambda days: days.between(91, 180)),
        ("6-12 months", lambda days: days.between(181, 365)),
    ),
    otherwise="12+ months",
)
INACTIVITY = Bands(
    (
        ("Churned", lambda days: days > 90),
        ("At High Risk", lambda days: days > 60),
        ("At Risk", lambda days: days > 30),
    ),
    otherwise="Active",
)
TIME_TO_PLAY = Bands(
    (
        ("Same Day", lambda days: days == 0),
        ("Next Day", lambda days: days == 1),
        ("2-7 Days", lambda days: days.between(2, 7)),
        ("8-30 Days", lambda days: days.between(8, 30)),
    ),
    otherwise="30+ Days",
)
DEPOSIT_SIZE = Bands(
    (
        ("< €10", lambda amount: amount < 10),
        ("€10-20", lambda amount: amount <= 20),
        ("€20-50", lambda amount: amount <= 50),
        ("€50-100", lambda amount: amount <= 100),
        ("€100-500", lambda amount: amount <= 500),
        ("€500-1000", lambda amount: amount <= 1000),
    ),
    otherwise="€1000+",
)
