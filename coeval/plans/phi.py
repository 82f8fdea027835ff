"""Spectrum distance of target and control coordinates from one VCF."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.operators import spectrum
from coeval.plans.validation import require_none
from coeval.session import RunFolder
from coeval.sources import vcf

KEYS = ["set_id"]
TARGET_SET = -1


@dataclass
class PhiResult:
    replicates: DataFrame
    bins: DataFrame
    counts: DataFrame


def calculate(
    lines: DataFrame,
    target: DataFrame,
    members: DataFrame,
    run: RunFolder,
    ancestral: str = "ref",
    ancestral_key: str = "AA",
    heterozygous: str = "error",
) -> PhiResult:
    """Phi-SFS of every set. ``target`` has (chrom, pos), ``members`` (set_id, chrom, pos).

    The text is scanned once, down to one (k, n) row per requested coordinate.
    """
    require_none(
        members.groupBy("set_id", "chrom", "pos").count().where("count > 1"), "controls repeated within a set"
    )
    everyone = target.select(F.lit(TARGET_SET).alias("set_id"), "chrom", "pos").unionByName(
        members.select(F.col("set_id").cast("int").alias("set_id"), "chrom", "pos")
    )
    requested = everyone.select("chrom", "pos").distinct()
    parsed = run.table(
        "site-counts", vcf.site_counts(lines, requested, ancestral, ancestral_key, heterozygous)
    )
    require_none(parsed.where("problem IS NOT NULL").select("chrom", "pos", "problem"), "VCF records")
    require_none(vcf.completeness_problems(requested, parsed), "requested coordinates")
    require_none(spectrum.count_problems(parsed), "derived counts")
    return from_counts(everyone, parsed.drop("problem"), ["chrom", "pos"], run)


def from_counts(everyone: DataFrame, counts: DataFrame, on: list[str], run: RunFolder) -> PhiResult:
    """Scores from member and count tables; set -1 is the target."""
    raw, tallies = spectrum.accumulate_spectra(everyone, counts, KEYS, on)
    spectra = run.table("spectra", raw)
    diagnostics = spectrum.retained_diagnostics(spectra, tallies, KEYS)
    require_none(
        diagnostics.where("coalesce(retained_mass, 0) <= 0").select("set_id"), "sets without retained mass"
    )
    normal = spectrum.normalise(spectra, KEYS)
    goal = normal.where(F.col("set_id") == TARGET_SET).select(
        "bin", F.col("normalised").alias("target_normalised"), F.col("raw").alias("target_raw")
    )
    bins = run.table(
        "bins",
        spectrum.phi_bins(goal.drop("target_raw"), normal.where(F.col("set_id") != TARGET_SET), KEYS)
        .join(goal.select("bin", "target_raw"), "bin"),
    )
    scores = spectrum.phi_scores(bins, KEYS).join(diagnostics, KEYS)
    require_none(scores.where("identity_max_abs_error > 1e-8").select("set_id"), "spectrum identity")
    return PhiResult(run.table("replicates", scores), bins, counts)
