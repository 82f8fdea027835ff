"""Hypergeometric projection of (k derived, n callable) onto m chromosomes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PROJECTION_SIZE = 20


def projection_mass(k: str, n: str, j: str, m: int = PROJECTION_SIZE) -> Column:
    """Probability of ``j`` derived alleles among ``m`` drawn from ``n`` holding ``k``.

    Written as m draws without replacement, ancestral ones first: each draw is
    one factor, an impossible draw is a zero factor, and no binomial larger
    than C(m, j) appears. The arguments name columns; the text form keeps the
    long product a single expression. Callers keep ``n >= m`` and
    ``0 <= k <= n``; see ``operators.spectrum``.
    """
    draws = [
        f"CASE WHEN {i} < {m} - {j} THEN greatest({n} - {k} - {i}, 0)"
        f" ELSE greatest({k} - ({i} - ({m} - {j})), 0) END / CAST({n} - {i} AS DOUBLE)"
        for i in range(m)
    ]
    orders = ", ".join(f"{math.comb(m, i)}D" for i in range(m + 1))
    return F.expr(" * ".join([f"element_at(array({orders}), {j} + 1)", *draws]))
