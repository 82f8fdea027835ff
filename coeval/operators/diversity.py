"""Reuse of controls over sets and mixing of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLAB_TILE = 1 << 20


def reuse_counts(members: DataFrame) -> DataFrame:
    """How many times each control appears over all sets."""
    return members.groupBy("row_id").agg(F.count("*").alias("uses"))


def reuse_summary(members: DataFrame) -> DataFrame:
    return reuse_counts(members).agg(
        F.count("*").alias("unique_controls"), F.max("uses").alias("maximum_reuse")
    )


def duplicate_members(members: DataFrame, keys: list[str]) -> DataFrame:
    """Controls held twice by one set; a valid result has none."""
    return members.groupBy(*keys, "row_id").agg(F.count("*").alias("times")).where("times > 1")


def adjacent_replacement(members: DataFrame) -> DataFrame:
    """1 - shared / size between consecutive saved sets of a chain.

    One row per member is matched to the same member of the previous set, so
    the work is linear in members.
    """
    sizes = members.groupBy("chain_index", "sample_index").agg(F.count("*").alias("_size"))
    ahead = members.select(
        "chain_index", (F.col("sample_index") + 1).alias("sample_index"), "row_id"
    )
    shared = (
        members.join(ahead, ["chain_index", "sample_index", "row_id"])
        .groupBy("chain_index", "sample_index")
        .agg(F.count("*").alias("_shared"))
    )
    return (
        sizes.where("sample_index > 0")
        .join(shared, ["chain_index", "sample_index"], "left")
        .select(
            "chain_index",
            "sample_index",
            (1.0 - F.coalesce("_shared", F.lit(0)) / F.col("_size")).alias("replacement"),
        )
    )


def replacement_fraction(current: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Fraction of the reference absent from the current set, per key."""
    marked = reference.select(*keys, "row_id").join(
        current.select(*keys, "row_id", F.lit(1).alias("_in")), [*keys, "row_id"], "left"
    )
    return marked.groupBy(*keys).agg(
        (F.count_if(F.col("_in").isNull()) / F.count("*")).alias("replacement")
    )


def chain_diversity(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Mixing summary per chain.

    ``sets`` has (chain_index, sample_index, wasserstein). The autocorrelation
    needs three saved sets and some variation; otherwise it is NULL.
    """
    adjacent = adjacent_replacement(members).groupBy("chain_index").agg(
        F.avg("replacement").alias("mean_replacement"),
        F.min("replacement").alias("minimum_replacement"),
    )
    before = F.lag("wasserstein").over(W.partitionBy("chain_index").orderBy("sample_index"))
    paired = sets.withColumn("_before", before)
    both = F.col("_before").isNotNull()
    spread = (F.stddev_pop(F.when(both, F.col("_before"))) > 0) & (
        F.stddev_pop(F.when(both, F.col("wasserstein"))) > 0
    )
    lagged = paired.groupBy("chain_index").agg(
        F.count("*").alias("sets"),
        F.corr("_before", "wasserstein").alias("_corr"),
        spread.alias("_spread"),
    )
    overlap = 1.0 - F.col("mean_replacement")
    return lagged.join(adjacent, "chain_index", "left").select(
        "chain_index",
        "sets",
        "mean_replacement",
        "minimum_replacement",
        F.when((F.col("sets") >= 3) & F.col("_spread"), F.col("_corr")).alias("lag1_autocorrelation"),
        (F.col("sets") * (1.0 - overlap) / (1.0 + overlap)).alias("membership_ess"),
    )


def coalesced_slabs(rows: DataFrame, gap: int) -> DataFrame:
    """Runs of requested rows whose holes are at most ``gap`` wide.

    Runs are found inside tiles a million rows wide. Only the first and last
    run of a tile can touch a neighbour, so the global window sees one row per
    tile and a run elsewhere is final at once.
    """
    tile = F.floor(F.col("row_id") / F.lit(SLAB_TILE)).alias("tile")
    local = W.partitionBy("tile").orderBy("row_id")
    opened = (F.col("row_id") - F.lag("row_id").over(local) > gap + 1).cast("int")
    runs = (
        rows.select("row_id", tile)
        .distinct()
        .withColumn("_open", F.coalesce(opened, F.lit(1)))
        .withColumn("run", F.sum("_open").over(local.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("tile", "run")
        .agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count("*").alias("n"))
    )
    along = W.orderBy("tile")
    tiles = (
        runs.groupBy("tile")
        .agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.max("run").alias("runs"))
        .withColumn("joins", F.coalesce(F.col("lo") - F.lag("hi").over(along) <= gap + 1, F.lit(False)))
        .withColumn(
            "_own",
            F.when((F.col("runs") > 1) | ~F.col("joins"), F.struct("tile", F.col("runs").alias("run"))),
        )
        .select(
            "tile",
            "joins",
            F.last("_own", ignorenulls=True)
            .over(along.rowsBetween(W.unboundedPreceding, -1))
            .alias("carried"),
        )
    )
    slab = F.when((F.col("run") == 1) & F.col("joins"), F.col("carried")).otherwise(
        F.struct("tile", "run")
    )
    return (
        runs.join(tiles, "tile")
        .groupBy(slab.alias("slab"))
        .agg(
            F.min("first").alias("first_row"),
            F.max("last").alias("last_row"),
            F.sum("n").alias("requested"),
        )
        .drop("slab")
    )
