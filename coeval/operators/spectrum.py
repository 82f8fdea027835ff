"""Projected site-frequency spectra and their distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.hypergeom import PROJECTION_SIZE, projection_mass
from coeval.session import RunFolder


def callable_sites(counts: DataFrame, m: int = PROJECTION_SIZE) -> DataFrame:
    """Sites with at least ``m`` callable samples; the others are dropped."""
    return counts.where(F.col("n") >= m)


def count_problems(counts: DataFrame) -> DataFrame:
    """Sites whose derived count lies outside [0, n]."""
    return counts.where((F.col("k") < 0) | (F.col("k") > F.col("n")))


def project_long(counts: DataFrame, m: int = PROJECTION_SIZE) -> DataFrame:
    """(k, n, bin, mass) of each distinct eligible pair, endpoints 0 and m included."""
    pairs = callable_sites(counts, m).select("k", "n").distinct()
    cells = pairs.select("k", "n", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("bin"))
    return cells.withColumn("mass", projection_mass("k", "n", "bin", m))


def accumulate_spectra(
    members: DataFrame, counts: DataFrame, keys: list[str], on: list[str], m: int = PROJECTION_SIZE
) -> tuple[DataFrame, DataFrame]:
    """Spectra and per-set diagnostics of member sites.

    Members meet their counts once and collapse to (set, k, n) multiplicities
    before any projection is evaluated, so that step costs distinct pairs, not
    members. Repeated members count each time. Sites with too few
    callable samples are dropped; nothing is renormalised per site.

    Returns (keys, bin, raw) for bins 0..m and (keys, input_sites,
    eligible_sites, dropped).
    """
    joined = members.join(counts.select(*on, "k", "n"), on, "left")
    enough = F.col("n") >= m
    # Three plans read the tallies, of which there are few, so they are written.
    tallied = RunFolder(members.sparkSession).table("tallied", joined.groupBy(*keys, "k", "n").agg(F.count("*").alias("_times")))
    totals = tallied.groupBy(*keys).agg(
        F.sum("_times").alias("input_sites"),
        F.coalesce(F.sum(F.when(enough, F.col("_times"))), F.lit(0)).alias("eligible_sites"),
    )
    # Each pair is projected once, whatever the number of sets that hold it.
    cells = tallied.where(enough).join(project_long(tallied, m), ["k", "n"])
    spectra = cells.groupBy(*keys, "bin").agg(F.sum(F.col("mass") * F.col("_times")).alias("raw"))
    diagnostics = totals.withColumn("dropped", F.col("input_sites") - F.col("eligible_sites"))
    return spectra, diagnostics


def normalise(spectra: DataFrame, keys: list[str], m: int = PROJECTION_SIZE) -> DataFrame:
    """Keep bins 1..m-1 and divide once by each set's retained mass.

    A set without retained mass yields NULL, which callers treat as an error.
    """
    retained = spectra.where(F.col("bin").between(1, m - 1))
    total = F.sum("raw").over(W.partitionBy(*keys)) if keys else F.sum("raw").over(W.partitionBy())
    return retained.withColumn("normalised", F.try_divide(F.col("raw"), total))


def phi_bins(target: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Per-bin residuals target - set; ``target`` has (bin, target_normalised)."""
    residual = F.col("target_normalised") - F.col("normalised")
    return sets.join(target, "bin").select(
        *keys,
        "bin",
        "raw",
        "normalised",
        "target_normalised",
        residual.alias("residual"),
        F.greatest(residual, F.lit(0.0)).alias("positive"),
    )


def phi_scores(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Total variation distance, both one-sided sums and half the L1 norm."""
    return (
        bins.groupBy(*keys)
        .agg(
            F.sum("positive").alias("phi_sfs"),
            F.sum(F.greatest(-F.col("residual"), F.lit(0.0))).alias("reverse_positive"),
            (F.sum(F.abs("residual")) / 2).alias("half_l1"),
        )
        .withColumns(
            {
                "overlap": 1.0 - F.col("phi_sfs"),
                "identity_max_abs_error": F.greatest(
                    F.abs(F.col("phi_sfs") - F.col("reverse_positive")),
                    F.abs(F.col("phi_sfs") - F.col("half_l1")),
                ),
            }
        )
    )


def retained_diagnostics(
    spectra: DataFrame, diagnostics: DataFrame, keys: list[str], m: int = PROJECTION_SIZE
) -> DataFrame:
    """Retained and endpoint mass, as totals and over eligible sites."""
    inner = F.col("bin").between(1, m - 1)
    masses = spectra.groupBy(*keys).agg(
        F.sum(F.when(inner, F.col("raw")).otherwise(0.0)).alias("retained_mass"),
        F.sum(F.when(~inner, F.col("raw")).otherwise(0.0)).alias("endpoint_mass"),
    )
    return diagnostics.join(masses, keys, "left").withColumns(
        {
            "retained_fraction": F.try_divide("retained_mass", "eligible_sites"),
            "endpoint_fraction": F.try_divide("endpoint_mass", "eligible_sites"),
        }
    )
