"""Validation as queries: each returns the offending rows, none when valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.schema import STATUS_USABLE


def interval_problem(below: Column, above: Column, allow_points: bool = False) -> Column:
    """Reason an interval is unusable, or NULL.

    Production stores need positive width; the accessory and dense paths accept
    a zero width.
    """
    infinite = F.lit(float("inf"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite)
    narrow = above < below if allow_points else above <= below
    return (
        F.when(~(finite(below) & finite(above)), F.lit("not finite"))
        .when(below < 0, F.lit("negative age"))
        .when(narrow, F.lit("width not positive"))
    )


def bad_intervals(intervals: DataFrame, allow_points: bool = False) -> DataFrame:
    problem = interval_problem(F.col("below"), F.col("above"), allow_points)
    return intervals.withColumn("problem", problem).where("problem IS NOT NULL")


def bad_row_ids(sites: DataFrame) -> DataFrame:
    """Repeats of a row id or position, and ids out of the range 0..n-1."""
    n = sites.count()
    repeated = lambda c: (
        sites.groupBy(F.col(c).alias("value")).count().where("count > 1")
        .select(F.lit(f"repeated {c}").alias("problem"), F.col("value").cast("bigint").alias("value"))
    )
    outside = sites.where((F.col("row_id") < 0) | (F.col("row_id") >= n)).select(
        F.lit("row_id out of range").alias("problem"), F.col("row_id").alias("value")
    )
    return repeated("row_id").unionByName(repeated("position")).unionByName(outside)


def bad_position_order(sites: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """Row ids that do not follow position order.

    Rows are checked against their predecessor inside tiles of row ids; each
    tile's first row is checked against the last row of the tile before.
    """
    tiled = sites.select("row_id", "position", F.floor(F.col("row_id") / tile).alias("tile"))
    before = F.lag("position").over(W.partitionBy("tile").orderBy("row_id"))
    inner = tiled.withColumn("previous", before).where(F.col("position") <= F.col("previous"))
    ends = tiled.groupBy("tile").agg(
        F.min_by("position", "row_id").alias("position"),
        F.min("row_id").alias("row_id"),
        F.max_by("position", "row_id").alias("last"),
    )
    across = ends.withColumn("previous", F.lag("last").over(W.orderBy("tile"))).where(
        F.col("position") <= F.col("previous")
    )
    columns = ["row_id", "position", "previous"]
    return inner.select(*columns).unionByName(across.select(*columns))


def bad_counters(sites: DataFrame, draws: int) -> DataFrame:
    """Counter identities that every catalog row must satisfy."""
    problem = (
        F.when(F.col("present_draws") + F.col("missing_draws") != draws, F.lit("present + missing"))
        .when(F.col("usable_draws") > F.col("present_draws"), F.lit("usable above present"))
        .when(F.col("usable_intervals") < F.col("usable_draws"), F.lit("intervals below draws"))
        .when(F.col("valid") != (F.col("usable_intervals") > 0), F.lit("valid flag"))
    )
    return sites.withColumn("problem", problem).where("problem IS NOT NULL")


def bad_coverage(sites: DataFrame, intervals: DataFrame) -> DataFrame:
    """Catalog rows whose counters disagree with the interval table."""
    counted = (
        intervals.groupBy("row_id", "draw_id").agg(F.count("*").alias("n"))
        .groupBy("row_id").agg(F.sum("n").alias("found"), F.count("*").alias("found_draws"))
    )
    joined = sites.select("row_id", "usable_intervals", "usable_draws").join(
        counted, "row_id", "full_outer"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.where(
        (zero("usable_intervals") != zero("found")) | (zero("usable_draws") != zero("found_draws"))
        | F.col("usable_intervals").isNull()
    )


def bad_status(status: DataFrame, intervals: DataFrame) -> DataFrame:
    """(draw, row) pairs whose status disagrees with the intervals present."""
    held = intervals.select("draw_id", "row_id").distinct().withColumn("held", F.lit(True))
    joined = status.join(held, ["draw_id", "row_id"], "full_outer")
    usable = F.coalesce(F.col("status") == STATUS_USABLE, F.lit(False))
    return joined.where(usable != F.coalesce("held", F.lit(False)))


def bad_codes(codes: DataFrame, bins: int, scale: int, sites: DataFrame | None = None) -> DataFrame:
    """Dense-store rows that are not monotone or do not end at full scale.

    With ``sites``, a row may end at zero only if its site has no usable interval.
    """
    order = W.partitionBy("row_id").orderBy("bin")
    marked = codes.withColumn("previous", F.lag("code").over(order))
    problem = (
        F.when(F.col("code") < F.col("previous"), F.lit("decreasing"))
        .when((F.col("bin") == bins - 1) & ~F.col("code").isin(0, scale), F.lit("terminal code"))
    )
    found = marked.withColumn("problem", problem).where("problem IS NOT NULL")
    if sites is None:
        return found
    ends = codes.where((F.col("bin") == bins - 1) & (F.col("code") == 0))
    empty = ends.join(sites.where("usable_intervals > 0").select("row_id"), "row_id", "left_semi")
    return found.unionByName(empty.select("*", F.lit(None).cast(codes.schema["code"].dataType).alias("previous"), F.lit("terminal code").alias("problem")))


#: Rows and bins of a tile whose cells are digested together.
TILE_ROWS, TILE_BINS = 1 << 12, 1 << 7


def layout_digests(codes: DataFrame) -> DataFrame:
    """(row_tile, bin_tile, cells, total, mixed): digests of the cells of every tile, in whatever order they lie."""
    cell = ["row_id", "bin", "code"]
    tiles = [F.floor(F.col("row_id") / TILE_ROWS).alias("row_tile"), F.floor(F.col("bin") / TILE_BINS).alias("bin_tile")]
    return codes.groupBy(*tiles).agg(
        F.count("*").alias("cells"),
        F.sum(F.xxhash64(*cell).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit("mixed"), *cell)).alias("mixed"),
    )


def bad_layouts(codes: DataFrame, other: DataFrame) -> DataFrame:
    """Tiles in which two layouts of a dense store do not hold the same cells.

    Each layout is read once and reduced to a few numbers a tile before they
    meet, so neither is sorted into the other's order.
    """
    names = ("cells", "total", "mixed")
    left, right = layout_digests(codes), layout_digests(other)
    right = right.withColumnsRenamed({c: f"other_{c}" for c in names})
    both = left.join(right, ["row_tile", "bin_tile"], "full_outer")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return both.where(~same).select("row_tile", "bin_tile", "cells", "other_cells")


def bad_members(
    members: DataFrame, sites: DataFrame, targets: DataFrame, keys: list[str], size: int,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Set members that break the rules of a matched set.

    A set must have ``size`` distinct eligible rows, none of them a target and,
    when a universe is declared, all of them inside it.
    """
    counted = members.groupBy(*keys, "row_id").agg(F.count("*").alias("times"))
    joined = counted.join(sites.select("row_id", "eligible"), "row_id", "left").join(
        targets.select("row_id", F.lit(True).alias("is_target")), "row_id", "left"
    )
    problem = (
        F.when(F.col("eligible").isNull(), F.lit("out of range"))
        .when(~F.col("eligible"), F.lit("ineligible"))
        .when(F.col("is_target"), F.lit("target row"))
        .when(F.col("times") > 1, F.lit("duplicate"))
    )
    if candidates is not None:
        joined = joined.join(
            candidates.select("row_id", F.lit(True).alias("declared")), "row_id", "left"
        )
        problem = F.coalesce(problem, F.when(F.col("declared").isNull(), F.lit("undeclared")))
    rows = joined.select(*keys, "row_id", problem.alias("problem")).where("problem IS NOT NULL")
    sizes = (
        members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != size)
        .select(*keys, F.lit(None).cast("bigint").alias("row_id"), F.lit("wrong size").alias("problem"))
    )
    return rows.unionByName(sizes)


def bad_distances(
    claimed: DataFrame, recomputed: DataFrame, keys: list[str], threshold: float | None = None,
    rtol: float = 1e-10, atol: float = 1e-8,
) -> DataFrame:
    """Claimed distances that recomputation from the members does not confirm."""
    both = claimed.select(*keys, F.col("wasserstein").alias("claimed")).join(
        recomputed.select(*keys, F.col("wasserstein").alias("certified")), keys, "full_outer"
    )
    off = F.abs(F.col("claimed") - F.col("certified")) > atol + rtol * F.abs(F.col("certified"))
    wrong = F.coalesce(off, F.lit(True))
    if threshold is not None:
        wrong = wrong | (F.col("certified") > threshold)
    return both.where(wrong)


def bad_cdfs(
    claimed: DataFrame, recomputed: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 1e-10
) -> DataFrame:
    """Stored set CDF cells that recomputation does not confirm."""
    both = claimed.select(*keys, "bin", F.col("cdf").alias("claimed")).join(
        recomputed.select(*keys, "bin", F.col("cdf").alias("certified")), [*keys, "bin"], "full_outer"
    )
    off = F.abs(F.col("claimed") - F.col("certified")) > atol + rtol * F.abs(F.col("certified"))
    return both.where(F.coalesce(off, F.lit(True)))


def triangle_problems(matches: DataFrame, slack: float = 1e-8) -> DataFrame:
    """Replicates whose three distances break the triangle inequality."""
    b, e, o = F.col("bootstrap_distance"), F.col("match_bootstrap"), F.col("match_observed")
    return matches.where(~((o + slack >= F.abs(b - e)) & (o <= b + e + slack)))


def require_none(problems: DataFrame, label: str, preview: int = 10) -> None:
    """Raise with a short preview when any offending row exists."""
    rows = problems.limit(preview).collect()
    if rows:
        raise ValueError(f"{label}: {[r.asDict() for r in rows]}")
