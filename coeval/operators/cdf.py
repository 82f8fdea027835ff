"""Mixture-of-uniforms CDFs per site, per set and per replicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid, interval_cdf_text, midpoint

# Points evaluated by one aggregate.
WIDE_POINTS = 64


def cdf_at(
    intervals: DataFrame,
    points: list[float],
    keys: list[str] | None = None,
    side: str = "right",
    weighting: str = "interval",
) -> DataFrame:
    """Long (keys, point_idx, point, cdf) table of CDF values.

    ``interval`` weighting averages intervals; ``draw`` weighting averages
    within each draw first. Points become one aggregate each, so a row is read
    once and the shuffle carries one partial row per key, not one per point.
    """
    if weighting not in ("interval", "draw"):
        raise ValueError("weighting must be 'interval' or 'draw'")
    keys = keys or ["row_id"]
    parts = [
        _cdf_at(intervals, points[i : i + WIDE_POINTS], i, keys, side, weighting)
        for i in range(0, max(1, len(points)), WIDE_POINTS)
    ]
    return reduce(DataFrame.unionAll, parts)


def _cdf_at(
    intervals: DataFrame, points: list[float], start: int, keys: list[str], side: str, weighting: str
) -> DataFrame:
    """Rows of one bounded run of points, numbered from ``start``."""
    names = [f"_p{i}" for i in range(len(points))]
    values = [F.expr(interval_cdf_text(p, side)) for p in points]
    if weighting == "interval":
        wide = intervals.groupBy(*keys).agg(*[F.avg(v).alias(n) for v, n in zip(values, names)])
    else:
        wide = (
            intervals.groupBy(*keys, "draw_id")
            .agg(*[F.avg(v).alias(n) for v, n in zip(values, names)])
            .groupBy(*keys)
            .agg(*[F.avg(n).alias(n) for n in names])
        )
    cells = ", ".join(
        f"named_struct('point_idx', {start + i}, 'point', {float(p)!r}D, 'cdf', {n})"
        for i, (p, n) in enumerate(zip(points, names))
    )
    return wide.select(*keys, F.expr(f"inline(array({cells}))"))


def boundary_cdfs(
    intervals: DataFrame, rows: DataFrame, ages: list[float], strategy: str = "gather"
) -> DataFrame:
    """CDFs of the requested rows at boundary ages, read from the left.

    ``gather`` reduces the facts to the rows first, ``scan`` evaluates every
    site and keeps the rows afterwards. Both give the same numbers; the first
    suits a small share of the sites, the second nearly all of them. A caller
    that asks repeatedly gathers from its own written subset.
    """
    wanted = rows.select("row_id")
    if strategy == "gather":
        return cdf_at(intervals.join(wanted, "row_id", "left_semi"), ages, side="left")
    if strategy == "scan":
        return cdf_at(intervals, ages, side="left").join(wanted, "row_id", "left_semi")
    raise ValueError("strategy must be 'gather' or 'scan'")


def mean_age(intervals: DataFrame, weighting: str = "interval") -> DataFrame:
    """Mean midpoint per site under either weighting."""
    middle = F.avg(midpoint(F.col("below"), F.col("above"))).alias("mean_age")
    if weighting == "interval":
        return intervals.groupBy("row_id").agg(middle)
    if weighting != "draw":
        raise ValueError("weighting must be 'interval' or 'draw'")
    return (
        intervals.groupBy("row_id", "draw_id")
        .agg(middle)
        .groupBy("row_id")
        .agg(F.avg("mean_age").alias("mean_age"))
    )


def cell_masses(
    intervals: DataFrame, edges: list[float], keys: list[str] | None = None
) -> DataFrame:
    """Mass of each half-open cell between consecutive edges, never negative."""
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be strictly increasing")
    keys = keys or ["row_id"]
    at_edges = cdf_at(intervals, edges, keys, side="left")
    before = F.lag("cdf").over(W.partitionBy(*keys).orderBy("point_idx"))
    return (
        at_edges.withColumn("_before", before)
        .where("point_idx > 0")
        .select(
            *keys,
            (F.col("point_idx") - 1).alias("cell"),
            F.greatest(F.col("cdf") - F.col("_before"), F.lit(0.0)).alias("mass"),
        )
    )


# --- Regular grids ---------------------------------------------------------
#
# On a regular grid an interval's CDF is zero, then linear, then one. Two
# changes describe it: at bin p the line starts, at bin q it stops and a
# constant one begins. Summing changes per bin and accumulating over bins gives
# any weighted mean of CDFs at a cost of intervals + bins.


def grid_changes(
    intervals: DataFrame, grid: Grid, keys: list[str], weight: Column, side: str = "left"
) -> DataFrame:
    """Summed changes (keys, bin, slope, intercept, complete).

    Every key also gets a zero change at bin 0, so a run always starts there.
    """
    below, above = F.col("below").cast("double"), F.col("above").cast("double")
    origin, step, bins = F.lit(grid.origin), F.lit(grid.width), F.lit(grid.bins)
    clip = lambda c: F.greatest(F.lit(0), F.least(bins, c)).cast("int")
    start = clip(F.ceil((below - origin) / step))
    jump = F.floor((below - origin) / step) + 1 if side == "left" else F.ceil((below - origin) / step)
    stop = clip(F.when(above == below, jump).otherwise(F.ceil((above - origin) / step)))
    zero = F.lit(0.0)
    rate = F.when(above > below, step * F.col("_w") / (above - below)).otherwise(zero)
    shift = F.when(above > below, (origin - below) * F.col("_w") / (above - below)).otherwise(zero)
    change = lambda b, s, i, c: F.struct(
        b.alias("bin"), s.alias("slope"), i.alias("intercept"), c.alias("complete")
    )
    changes = F.array(
        change(F.lit(0), zero, zero, zero),
        change(start, rate, shift, zero),
        change(stop, -rate, -shift, F.col("_w")),
    )
    return (
        intervals.withColumn("_w", weight.cast("double"))
        .select(*keys, F.inline(changes))
        .where(F.col("bin") < bins)
        .groupBy(*keys, "bin")
        .agg(*[F.sum(c).alias(c) for c in ("slope", "intercept", "complete")])
    )


def accumulate(changes: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Changes to a dense (keys, bin, cdf) table."""
    return lines(changes, grid, keys).select(
        *keys, "bin", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))).alias("cdf")
    )


def lines(changes: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Changes to a dense (keys, bin, value) table, whatever the values are.

    Between two changes the CDF is one straight line, so each change expands to
    the bins up to the next one; no grid table is joined. A window group holds
    at most one row per bin.
    """
    order = W.partitionBy(*keys).orderBy("bin")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = changes.select(
        *keys,
        "bin",
        F.coalesce(F.lead("bin").over(order), F.lit(grid.bins)).alias("_next"),
        F.sum("slope").over(so_far).alias("_slope"),
        (F.sum("intercept").over(so_far) + F.sum("complete").over(so_far)).alias("_level"),
    )
    cells = runs.select(
        *keys,
        F.explode(F.sequence(F.col("bin"), F.col("_next") - 1)).alias("bin"),
        "_slope",
        "_level",
    )
    return cells.select(*keys, "bin", (F.col("bin") * F.col("_slope") + F.col("_level")).alias("value"))


def with_counts(intervals: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add each site's ``usable_intervals`` to its intervals.

    A stored interval table already carries the column. Otherwise the count is
    aggregated and joined back, which adaptive execution can split for a hot
    site, unlike a window over the site.
    """
    if "usable_intervals" in intervals.columns:
        return intervals
    if counts is None:
        counts = intervals.groupBy("row_id").agg(F.count("*").alias("usable_intervals"))
    return intervals.join(counts.select("row_id", "usable_intervals"), "row_id")


def row_changes(intervals: DataFrame, grid: Grid, side: str = "left") -> DataFrame:
    """Per-site changes whose weights sum to one at each site."""
    weight = F.lit(1.0) / F.col("usable_intervals")
    return grid_changes(with_counts(intervals), grid, ["row_id"], weight, side)


def row_grid_cdf(intervals: DataFrame, grid: Grid, side: str = "left") -> DataFrame:
    """Dense CDF of every site on the grid."""
    return accumulate(row_changes(intervals, grid, side), grid, ["row_id"])


def set_changes(members: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of member changes per set; repeated members count each time.

    Members are first counted per (set, row), then joined once to the changes.
    Every site has exactly one change at bin 0, so the members counted there
    are the size of the set.
    """
    names = ("slope", "intercept", "complete")
    counted = members.groupBy(*keys, "row_id").agg(F.count("*").alias("_times"))
    summed = (
        counted.join(changes, "row_id")
        .groupBy(*keys, "bin")
        .agg(
            *[F.sum(F.col(c) * F.col("_times")).alias(c) for c in names],
            F.sum(F.when(F.col("bin") == 0, F.col("_times")).otherwise(0)).alias("_members"),
        )
        .withColumn("_size", F.max("_members").over(W.partitionBy(*keys)))
    )
    return summed.select(*keys, "bin", *[(F.col(c) / F.col("_size")).alias(c) for c in names])


def set_cdf(members: DataFrame, changes: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Dense mean CDF of each set of rows."""
    return accumulate(set_changes(members, changes, keys), grid, keys)


def wasserstein(
    cdf: DataFrame, target: DataFrame, grid: Grid, keys: list[str], name: str = "wasserstein"
) -> DataFrame:
    """W1 between each CDF and ``target`` (bin, target_cdf): the last bin is ignored.

    Key columns both sides hold pick each key's own target; a key only the
    target holds compares every CDF with every target.
    """
    gap = F.abs(F.col("cdf") - F.col("target_cdf")) * F.lit(grid.width)
    on = [c for c in target.columns if c != "target_cdf" and c in cdf.columns]
    return (
        cdf.join(target, on)
        .where(F.col("bin") < grid.bins - 1)
        .groupBy(*keys)
        .agg(F.sum(gap).alias(name))
    )


def wasserstein_on_ages(cdfs: DataFrame, keys: list[str]) -> DataFrame:
    """W1 on any increasing age grid, from rows (keys, age, cdf, target_cdf)."""
    ahead = F.lead("age").over(W.partitionBy(*keys).orderBy("age"))
    gap = F.abs(F.col("cdf") - F.col("target_cdf")) * (F.col("_next") - F.col("age"))
    return (
        cdfs.withColumn("_next", ahead)
        .where("_next IS NOT NULL")
        .groupBy(*keys)
        .agg(F.sum(gap).alias("wasserstein"))
    )


def profiles(changes: DataFrame) -> DataFrame:
    """One row per site holding its changes as arrays, at most one entry per bin."""
    packed = changes.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "slope", "intercept", "complete"))).alias("c")
    )
    return packed.select(
        "row_id",
        F.col("c.bin").alias("bins"),
        F.col("c.slope").alias("slopes"),
        F.col("c.intercept").alias("intercepts"),
        F.col("c.complete").alias("completes"),
    )
