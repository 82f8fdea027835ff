"""Union site catalog, coverage counters and draw status."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.operators.ranks import POSITION_TILE, dense_row_ids, ordinal_in_group
from coeval.schema import STATUS_ABSENT, STATUS_UNUSABLE, STATUS_USABLE


def union_catalog(draw_sites: DataFrame, tile: int = POSITION_TILE) -> DataFrame:
    """Distinct positions over all draws with their dense 0-based ``row_id``."""
    positions = draw_sites.select(F.col("position").cast("bigint").alias("position")).distinct()
    return dense_row_ids(positions, tile)


def per_draw_coverage(mutations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per (site, draw) counts of usable and root mutations.

    ``mutations`` has one row per mutation with ``above`` NULL where the
    mutation has no parent. Partial aggregation removes any hot site before
    the shuffle.
    """
    keys = keys or ["position"]
    usable = F.col("above").isNotNull()
    return mutations.groupBy(*keys, "draw_id").agg(
        F.count_if(usable).alias("usable"), F.count_if(~usable).alias("roots")
    )


def site_coverage(
    per_draw: DataFrame, draws: int, min_usable_fraction: float, keys: list[str] | None = None
) -> DataFrame:
    """The five coverage counters plus the valid / eligible flags."""
    if draws <= 0 or not 0 < min_usable_fraction <= 1:
        raise ValueError("draws must be positive and the usable fraction in (0, 1]")
    keys = keys or ["position"]
    required = required_draws(draws, min_usable_fraction)
    counted = per_draw.groupBy(*keys).agg(
        F.count("*").alias("present_draws"),
        (F.lit(draws) - F.count("*")).alias("missing_draws"),
        F.count_if(F.col("usable") > 0).alias("usable_draws"),
        F.sum("usable").alias("usable_intervals"),
        F.sum("roots").alias("skipped_roots"),
    )
    valid = F.col("usable_intervals") > 0
    return counted.withColumns(
        {"valid": valid, "eligible": valid & (F.col("usable_draws") >= F.lit(required))}
    )


def required_draws(draws: int, min_usable_fraction: float) -> int:
    return math.ceil(min_usable_fraction * draws)


def draw_status(per_draw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Present (draw, site) pairs with status 1 or 2; an absent pair has no row."""
    keys = keys or ["position"]
    status = F.when(F.col("usable") > 0, F.lit(STATUS_USABLE)).otherwise(F.lit(STATUS_UNUSABLE))
    return per_draw.select("draw_id", *keys, status.alias("status"))


def read_status(status: DataFrame, draws: list[int], rows: DataFrame) -> DataFrame:
    """Status of every requested (draw, row), 0 where the pair is absent.

    ``draws`` is the requested draw order and ``rows`` has (row_order, row_id).
    """
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("draw_order"), F.lit(int(d)).alias("draw_id"))
            for i, d in enumerate(draws)
        ]
    )
    cells = rows.select("row_order", "row_id", F.inline(wanted))
    return cells.join(status, ["draw_id", "row_id"], "left").select(
        "draw_order",
        "draw_id",
        "row_order",
        "row_id",
        F.coalesce("status", F.lit(STATUS_ABSENT)).alias("status"),
    )


def missing_pairs(draw_sites: DataFrame, draws: list[int]) -> DataFrame:
    """(position, draw_id) pairs of the union catalog that a draw lacks.

    A position's set of draws is at most the number of draws long.
    """
    every = F.array(*[F.lit(int(d)) for d in draws])
    seen = draw_sites.groupBy(F.col("position").cast("bigint").alias("position")).agg(
        F.collect_set("draw_id").alias("_seen")
    )
    return seen.select("position", F.explode(F.array_except(every, "_seen")).alias("draw_id"))


def coverage_totals(sites: DataFrame) -> DataFrame:
    """Column sums of the coverage counters over the whole catalog."""
    names = ["present_draws", "missing_draws", "usable_draws", "usable_intervals", "skipped_roots"]
    return sites.agg(*[F.sum(n).alias(n) for n in names])


def mutation_order(intervals: DataFrame) -> DataFrame:
    """Ordinal of each interval inside its site: draw order, then mutation order."""
    return ordinal_in_group(intervals, ["row_id"], ["draw_id", "mutation_id"], "mutation_id")


def bucket_statistics(row_intervals: DataFrame, rows: int, buckets: int) -> DataFrame:
    """Interval count per contiguous row bucket (rows cut evenly over the catalog).

    ``row_intervals`` has (row_id, usable_intervals).
    """
    bucket = F.least(
        F.floor(F.col("row_id") * F.lit(buckets) / F.lit(rows)), F.lit(buckets - 1)
    ).cast("int")
    return row_intervals.groupBy(bucket.alias("bucket")).agg(
        F.sum("usable_intervals").alias("intervals"), F.count("*").alias("rows")
    )
