"""Ranks and order statistics without an unpartitioned window over facts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITION_TILE = 1 << 20
KEY_SLOTS = 1 << 12


def dense_row_ids(positions: DataFrame, tile: int = POSITION_TILE) -> DataFrame:
    """Number distinct integer ``position`` values 0.. in increasing order.

    Rows are ranked inside fixed-width tiles, so no group exceeds ``tile`` rows;
    only the table of tiles (genome length / tile) meets a global window.
    """
    tiled = positions.select(
        "position", F.floor(F.col("position") / F.lit(tile)).cast("bigint").alias("tile")
    )
    before = W.orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        tiled.groupBy("tile")
        .agg(F.count("*").alias("tile_rows"))
        .select("tile", F.coalesce(F.sum("tile_rows").over(before), F.lit(0)).alias("start"))
    )
    in_tile = F.row_number().over(W.partitionBy("tile").orderBy("position"))
    return (
        tiled.withColumn("in_tile", in_tile)
        .join(starts, "tile")
        .select((F.col("start") + F.col("in_tile") - 1).alias("row_id"), "position")
    )


def ordinal_in_group(
    df: DataFrame, groups: list[str], order: list[str], tile_by: str, tile: int = POSITION_TILE
) -> DataFrame:
    """0-based ``ord`` of each row in its group, ordered by ``order``.

    The last order column, ``tile_by``, is cut into tiles. Rows are ranked
    inside (group, leading order columns, tile) and shifted by the counts of
    the tiles before, so one huge group is ranked by many tasks.
    """
    lead = [c for c in order if c != tile_by]
    cut = df.withColumn("_tile", F.floor(F.col(tile_by) / F.lit(tile)))
    pieces = cut.groupBy(*groups, *lead, "_tile").agg(F.count("*").alias("_n"))
    before = (
        W.partitionBy(*groups).orderBy(*lead, "_tile").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy(*groups, *lead, "_tile").orderBy(tile_by))
    return (
        cut.withColumn("_rank", rank)
        .join(starts, [*groups, *lead, "_tile"])
        .withColumn("ord", F.col("_start") + F.col("_rank") - 1)
        .drop("_tile", "_rank", "_start")
    )


def smallest_by_key(
    df: DataFrame,
    groups: list[str],
    key: str,
    tie: str,
    take: Column,
    slot: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Keep the ``take`` rows with the smallest ``key`` in each group, exactly.

    ``slot`` is a coarse integer that never decreases with ``key``. A counted
    histogram of slots settles every slot but one per group, and only that one
    is sorted. A group can hold any share of the table: its rows are spread by
    slot, never gathered. ``take`` may refer to columns of ``df`` that are
    constant within a group.
    """
    if slot is None:
        slot = F.floor(F.col(key) * F.lit(KEY_SLOTS))
    if descending:
        slot = -slot
    slotted = df.withColumn("_slot", slot.cast("bigint")).withColumn(
        "_take", take.cast("bigint")
    )
    running = W.partitionBy(*groups).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    histogram = (
        slotted.groupBy(*groups, "_slot")
        .agg(F.count("*").alias("_n"), F.max("_take").alias("_want"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .where(F.col("_before") < F.col("_want"))
        .select(
            *[F.col(g) for g in groups],
            "_slot",
            F.least(F.col("_n"), F.col("_want") - F.col("_before")).alias("_keep"),
            (F.col("_before") + F.col("_n") <= F.col("_want")).alias("_whole"),
        )
    )
    matched = slotted.join(histogram, [*groups, "_slot"])
    whole = matched.where("_whole")
    order = F.col(key).desc() if descending else F.col(key).asc()
    rank = F.row_number().over(W.partitionBy(*groups, "_slot").orderBy(order, F.col(tie)))
    cut = matched.where(~F.col("_whole")).withColumn("_rank", rank)
    cut = cut.where(F.col("_rank") <= F.col("_keep")).drop("_rank")
    return whole.unionByName(cut).drop("_slot", "_take", "_keep", "_whole")


def empirical_quantile(values: DataFrame, column: str, quantile: float) -> DataFrame:
    """The ``ceil((n - 1) * quantile)``-th smallest value: an observed one, rounded up.

    Values are counted in equal steps between the least and the largest; only
    the step that holds the rank is sorted, so any number of rows will do.
    """
    if not 0 < quantile < 1:
        raise ValueError("quantile must be strictly between zero and one")
    rows = values.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    ends = rows.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).first()
    if not ends["n"]:
        return rows.select(F.col("value").alias("threshold"))
    wanted = math.ceil((ends["n"] - 1) * quantile)
    width = (ends["high"] - ends["low"]) or 1.0
    step = F.least(F.floor((F.col("value") - ends["low"]) / width * KEY_SLOTS), F.lit(KEY_SLOTS - 1)).alias("step")
    stepped = rows.select("value", step)
    before = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    counts = stepped.groupBy("step").agg(F.count("*").alias("held")).withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    at = counts.where((F.col("start") <= wanted) & (F.col("start") + F.col("held") > wanted))
    ranked = stepped.join(at, "step").withColumn("rank", F.col("start") + F.row_number().over(W.partitionBy("step").orderBy("value")) - 1)
    return ranked.where(F.col("rank") == wanted).select(F.col("value").alias("threshold"))


def stratified_sample(
    df: DataFrame, flag: str, key: str, tie: str, size: int
) -> DataFrame:
    """``size`` rows, half of them flagged; a short half is filled from the other.

    Rows are taken by smallest counter ``key`` within each half.
    """
    counts = {r[flag]: r["n"] for r in df.groupBy(flag).agg(F.count("*").alias("n")).collect()}
    yes, no = counts.get(True, 0), counts.get(False, 0)
    from_yes = min(yes, max(size // 2, size - no))
    from_no = min(no, size - from_yes)
    take = F.when(F.col(flag), F.lit(from_yes)).otherwise(F.lit(from_no))
    return smallest_by_key(df, [flag], key, tie, take)
