"""Target CDF, bootstrap tolerance, equal-mass strata and quotas."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators import bootstrap, cdf, strata
from coeval.operators.ranks import empirical_quantile
from coeval.session import RunFolder


@dataclass(frozen=True)
class TargetConfig:
    bin_width: float = 1000.0
    replicates: int = 10_000
    quantile: float = 0.5
    seed: int = 0
    acceptance_distance: float | None = None

    def validate(self) -> None:
        if self.bin_width <= 0 or self.replicates <= 0:
            raise ValueError("bin width and replicates must be positive")
        if not 0 < self.quantile < 1:
            raise ValueError("quantile must be strictly between zero and one")
        distance = self.acceptance_distance
        if distance is not None and not (math.isfinite(distance) and distance > 0):
            raise ValueError("acceptance distance must be finite and positive")


@dataclass
class Target:
    grid: Grid
    size: int
    rows: DataFrame
    changes: DataFrame
    cdf: DataFrame
    distances: DataFrame
    strata: DataFrame
    threshold: float


def mean_target(rows: DataFrame, changes: DataFrame, grid: Grid) -> DataFrame:
    """Mean CDF of the target rows as (bin, target_cdf)."""
    one = rows.select("row_id", F.lit(0).alias("set_id"))
    return cdf.set_cdf(one, changes, grid, ["set_id"]).select("bin", F.col("cdf").alias("target_cdf"))


def build_target(
    intervals: DataFrame,
    target_rows: DataFrame,
    maximum_above: float,
    config: TargetConfig,
    run: RunFolder,
) -> Target:
    """All target products from an interval store, on the configured grid."""
    config.validate()
    grid = Grid.spanning(maximum_above, config.bin_width)
    own = intervals.join(target_rows.select("row_id"), "row_id", "left_semi")
    return target_from_changes(cdf.row_changes(own, grid), target_rows, grid, config, run)


def target_from_changes(
    changes: DataFrame, target_rows: DataFrame, grid: Grid, config: TargetConfig, run: RunFolder
) -> Target:
    """All target products from per-site changes, of whichever store they came.

    Facts are reduced to the target rows' changes once. An absolute acceptance
    distance overrides the bootstrap quantile.
    """
    config.validate()
    rows = run.table("target/rows", bootstrap.index_targets(target_rows))
    size = rows.count()
    if size == 0:
        raise ValueError("target set is empty")
    changes = run.table("target/changes", changes.join(rows.select("row_id"), "row_id", "left_semi"))
    if changes.select("row_id").distinct().count() != size:
        raise ValueError("some target rows have no usable interval")
    observed = run.table("target/cdf", mean_target(rows, changes, grid))
    draws = bootstrap.Draws(run.spark, size, config.replicates, config.seed)
    distances = run.table("target/distances", bootstrap.replicate_distances(draws, rows, changes, observed, grid))
    spans = strata.strata(strata.equal_mass_edges(observed, grid))
    quotas = run.table("target/strata", strata.largest_remainder(spans, size))
    threshold = config.acceptance_distance
    if threshold is None:
        threshold = empirical_quantile(distances, "wasserstein", config.quantile).first()["threshold"]
    return Target(grid, size, rows, changes, observed, distances, quotas, float(threshold))
