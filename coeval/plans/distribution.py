"""Binned age distribution of requested positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators.density import binned_pdf


def estimate_distributions(aged: DataFrame, grid: Grid, draws: int) -> DataFrame:
    """(position, bin, probability, interval_count, missing_draws), touched bins only.

    ``aged`` has one row per mutation with ``above`` NULL for a root mutation.
    Zero-width intervals are kept. A position counts as missing in a draw that
    holds no mutation there.
    """
    counted = (
        aged.groupBy("position", "draw_id").agg(F.count("above").alias("n"))
        .groupBy("position")
        .agg(
            F.sum("n").alias("interval_count"),
            (F.lit(draws) - F.count("*")).alias("missing_draws"),
        )
    )
    usable = aged.where("above IS NOT NULL").select("position", "below", "above")
    pdf = binned_pdf(usable, grid, ["position"]).join(touched_bins(usable, grid), ["position", "bin"], "left_semi")
    return pdf.withColumn("probability", F.greatest("probability", F.lit(0.0))).join(counted, "position")


def touched_bins(intervals: DataFrame, grid: Grid) -> DataFrame:
    """(position, bin) of every bin that some interval of the position overlaps.

    A zero-width interval touches its nearest bin. Intervals open and close runs
    of bins; running sums of these find the bins, so the work follows the
    intervals and the bins they cover.
    """
    first = F.floor(F.col("below") / grid.width + 0.5)
    last = F.when(F.col("above") == F.col("below"), first).otherwise(F.ceil(F.col("above") / grid.width + 0.5) - 1)
    ends = F.explode(F.array(F.struct(first.alias("bin"), F.lit(1).alias("step")), F.struct((last + 1).alias("bin"), F.lit(-1).alias("step"))))
    steps = intervals.select("position", ends.alias("e")).groupBy("position", "e.bin").agg(F.sum("e.step").alias("step"))
    order = W.partitionBy("position").orderBy("bin")
    runs = steps.withColumns(
        {"open": F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)), "next": F.lead("bin").over(order)}
    )
    runs = runs.where("open > 0")
    last_bin = F.least(F.col("next") - 1, F.lit(grid.bins - 1).cast("bigint"))
    listed = runs.select("position", F.explode(F.sequence(F.col("bin"), last_bin)).alias("bin"))
    return listed.select("position", F.col("bin").cast("int").alias("bin"))
