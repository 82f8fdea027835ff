"""Age grids and the closed forms evaluated on them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Uniform age grid: bin ``j`` is centred on ``j * width``.

    CDFs are read at the upper edge of each bin, so the last point lies beyond
    the oldest usable age and every CDF ends at one.
    """

    width: float
    bins: int

    @classmethod
    def spanning(cls, maximum_age: float, width: float) -> "Grid":
        if not (math.isfinite(maximum_age) and maximum_age > 0 and width > 0):
            raise ValueError("maximum age and bin width must be positive")
        last = max(1, math.floor(maximum_age / width + 0.5))
        return cls(float(width), last + 1)

    @property
    def origin(self) -> float:
        return self.width / 2

    def centers(self) -> list[float]:
        return [j * self.width for j in range(self.bins)]

    def points(self) -> list[float]:
        return [c + self.width / 2 for c in self.centers()]

    def edges(self) -> list[float]:
        return [-self.width / 2, *self.points()]


def interval_cdf(below: Column, above: Column, point: Column, side: str = "right") -> Column:
    """CDF at ``point`` of the uniform law on ``[below, above]``.

    ``side`` matters only for a zero-width interval: a point mass counts at its
    own age from the right and not from the left.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    reached = point >= below if side == "right" else point > below
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (point - below) / (above - below)))
    return F.when(above == below, reached.cast("double")).otherwise(ramp)


def interval_cdf_text(point: float, side: str = "right") -> str:
    """:func:`interval_cdf` of columns ``below`` and ``above`` as one text expression.

    Used where many points become many aggregates.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    at = f"{float(point)!r}D"
    reached = ">=" if side == "right" else ">"
    return (
        f"CASE WHEN above = below THEN CAST({at} {reached} below AS DOUBLE) ELSE "
        f"greatest(0D, least(1D, ({at} - CAST(below AS DOUBLE)) / (CAST(above AS DOUBLE) - CAST(below AS DOUBLE)))) END"
    )


def nearest_bin(age: Column, width: float) -> Column:
    """Index of the closest bin centre; a tie goes to the older bin."""
    return F.floor(age / F.lit(float(width)) + F.lit(0.5))


def midpoint(below: Column, above: Column) -> Column:
    return (below + above) / F.lit(2.0)
