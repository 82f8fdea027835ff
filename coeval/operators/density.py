"""Binned age densities and quantised CDFs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators.cdf import accumulate, grid_changes
from coeval.schema import CDF_SCALE


def binned_pdf(intervals: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Probability of each age bin ``[c - w/2, c + w/2)``, pooled over intervals.

    Bin masses are the steps of the CDF at upper bin edges, read from the left:
    a zero-width interval then falls wholly into its nearest bin, ties to the
    older one. Masses are normalised over the grid.
    """
    changes = grid_changes(intervals, grid, keys, F.lit(1.0))
    order = W.partitionBy(*keys).orderBy("bin")
    whole = W.partitionBy(*keys)
    raw = _pooled_cdf(changes, grid, keys)
    stepped = raw.withColumn("mass", F.col("cdf") - F.coalesce(F.lag("cdf").over(order), F.lit(0.0)))
    return stepped.withColumn("probability", F.try_divide("mass", F.sum("mass").over(whole))).select(
        *keys, "bin", "probability"
    )


def _pooled_cdf(changes: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """CDF of all intervals pooled with equal weight."""
    total = F.sum("complete").over(W.partitionBy(*keys))
    scaled = changes.withColumn("_total", total).select(
        *keys,
        "bin",
        *[F.try_divide(F.col(c), F.col("_total")).alias(c) for c in ("slope", "intercept", "complete")],
    )
    return accumulate(scaled, grid, keys)


def quantise(cdf: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """CDF to monotone 16-bit codes ending at full scale.

    Halves round to even. The running maximum repairs any step down left by
    rounding; an all-zero row stays zero.
    """
    order = W.partitionBy(*keys).orderBy("bin")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    code = F.max(F.rint(F.col("cdf") * F.lit(float(CDF_SCALE)))).over(so_far)
    ended = F.when((F.col("bin") == grid.bins - 1) & (F.max("cdf").over(whole) > 0), F.lit(float(CDF_SCALE)))
    return cdf.select(*keys, "bin", F.coalesce(ended, code).cast("int").alias("code"))


def dequantise(codes: DataFrame) -> DataFrame:
    """Codes back to single-precision CDF values."""
    value = (F.col("code").cast("float") / F.lit(float(CDF_SCALE)).cast("float")).cast("float")
    return codes.withColumn("cdf", value)


def boundary_codes(codes: DataFrame, edges: list[int], keys: list[str]) -> DataFrame:
    """Codes at CDF edge indices: edge 0 is zero, edge e is bin e - 1."""
    wanted = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(i).alias("edge_idx"), F.lit(e).alias("edge")) for i, e in enumerate(edges)]),
            lambda x: F.when(x["edge"] == 0, F.col("bin") == 0).otherwise(x["edge"] - 1 == F.col("bin")),
        )
    )
    return codes.select(*keys, "code", wanted.alias("w")).select(
        *keys,
        F.col("w.edge_idx").alias("edge_idx"),
        F.col("w.edge").alias("edge"),
        F.when(F.col("w.edge") == 0, F.lit(0)).otherwise(F.col("code")).alias("code"),
    )


def code_changes(codes: DataFrame) -> DataFrame:
    """Dense codes as per-site changes, so every set operator reads either store.

    A quantised CDF is a step at each bin; a step of zero is dropped except at
    bin 0, where every site keeps its one change.
    """
    order = W.partitionBy("row_id").orderBy("bin")
    step = (F.col("code") - F.coalesce(F.lag("code").over(order), F.lit(0))) / F.lit(float(CDF_SCALE))
    return (
        codes.withColumn("complete", step)
        .where((F.col("bin") == 0) | (F.col("complete") != 0))
        .select("row_id", "bin", F.lit(0.0).alias("slope"), F.lit(0.0).alias("intercept"), "complete")
    )
