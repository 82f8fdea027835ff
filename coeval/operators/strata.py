"""Equal-mass age strata and integer quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid

PROBABILITY_STEPS = 20
EDGES = "array<struct<edge:int,edge_cdf:double,label_age:double>>"


def equal_mass_edges(target: DataFrame, grid: Grid, steps: int = PROBABILITY_STEPS) -> DataFrame:
    """(edge, age, label_age, edge_cdf) of the compressed quantile edges.

    Edge 0 carries no mass and edge e that of bins 0..e-1. Each probability
    ``i / steps`` picks the first edge reaching it; the first and last edges are
    always kept. The input has one row per bin, so its windows are grid-sized.
    """
    by_bin = W.orderBy("bin")
    scaled = target.select(
        "bin", (F.col("target_cdf") / F.last("target_cdf").over(by_bin.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("edge_cdf")
    ).withColumn("_before", F.coalesce(F.lag("edge_cdf").over(by_bin), F.lit(0.0)))
    probabilities = F.array(*[F.lit(i * (1.0 / steps)) for i in range(1, steps)])
    reached = F.exists(probabilities, lambda p: (p > F.col("_before")) & (p <= F.col("edge_cdf")))
    kept = reached | (F.col("bin") == grid.bins - 1)
    edge = F.struct(
        (F.col("bin") + 1).cast("int").alias("edge"),
        F.col("edge_cdf").alias("edge_cdf"),
        (F.col("bin") * F.lit(grid.width)).alias("label_age"),
    )
    first = F.struct(
        F.lit(0).alias("edge"), F.lit(0.0).alias("edge_cdf"), F.lit(0.0).alias("label_age")
    )
    starts = F.when(F.col("bin") == 0, F.array(first)).otherwise(F.array().cast(EDGES))
    ends = F.when(kept, F.array(edge)).otherwise(F.array().cast(EDGES))
    age = (F.col("edge") - F.lit(0.5)) * F.lit(grid.width)
    return scaled.select(F.inline(F.concat(starts, ends))).select(
        "edge", age.alias("age"), "label_age", "edge_cdf"
    )


def strata(edges: DataFrame) -> DataFrame:
    """Consecutive edges to (stratum, first_edge, last_edge, ages, share)."""
    order = W.orderBy("edge")
    spans = edges.select(
        (F.row_number().over(order) - 1).alias("stratum"),
        F.col("edge").alias("first_edge"),
        F.lead("edge").over(order).alias("last_edge"),
        F.col("age").alias("from_age"),
        F.lead("age").over(order).alias("to_age"),
        (F.lead("edge_cdf").over(order) - F.col("edge_cdf")).alias("raw"),
    ).where("last_edge IS NOT NULL")
    kept = F.when(F.abs("raw") < 1e-15, F.lit(0.0)).otherwise(F.col("raw"))
    return (
        spans.withColumn("_kept", kept)
        .withColumn("share", F.col("_kept") / F.sum("_kept").over(W.partitionBy()))
        .drop("raw", "_kept")
    )


def largest_remainder(shares: DataFrame, total: int) -> DataFrame:
    """Integer quotas summing to ``total``; ties go to the earliest stratum."""
    ideal = F.col("share") * F.lit(total)
    based = shares.withColumns(
        {"_floor": F.floor(ideal).cast("bigint"), "_fraction": ideal - F.floor(ideal)}
    )
    left = F.lit(total) - F.sum("_floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.col("_fraction").desc(), F.col("stratum")))
    return (
        based.withColumns({"_left": left, "_rank": rank})
        .withColumn("quota", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("bigint"))
        .drop("_floor", "_fraction", "_left", "_rank")
    )
