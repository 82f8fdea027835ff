"""Certify and publish matched control sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators import bootstrap, cdf, coordinates, diversity
from coeval.plans import validation
from coeval.plans.swap import Chains
from coeval.plans.target import Target
from coeval.sinks.publish import publish
from coeval.sources.bundles import CONTROLS, Bundle, source_identity

KEYS = ["chain_index", "sample_index"]


def certify(
    chains: Chains, sites: DataFrame, intervals: DataFrame, target: Target, candidates: DataFrame
) -> None:
    """Recheck rules, CDFs and distances of every saved set from its members alone."""
    members = chains.members
    validation.require_none(
        validation.bad_members(members, sites, target.rows, KEYS, target.size, candidates), "set members"
    )
    own = intervals.join(members.select("row_id").distinct(), "row_id", "left_semi")
    means = cdf.set_cdf(members, cdf.row_changes(own, target.grid), target.grid, KEYS)
    validation.require_none(validation.bad_cdfs(chains.cdfs, means, KEYS), "set CDFs")
    distances = cdf.wasserstein(means, target.cdf, target.grid, KEYS)
    validation.require_none(
        validation.bad_distances(chains.sets, distances, KEYS, target.threshold), "set distances"
    )


def native_members(members: DataFrame, store: Bundle) -> DataFrame:
    """Members with their chromosome and native position."""
    chromosomes = store.table("chromosomes")
    placed = members.join(store.table("sites").select("row_id", "position"), "row_id")
    return coordinates.global_to_native(placed, chromosomes)


def publish_controls(
    spark: SparkSession, destination: str, chains: Chains, store: Bundle, target: Target,
    target_identity: dict, seed: int, config: dict, step: str | None = None, audit: dict[str, DataFrame] | None = None,
) -> None:
    members = native_members(chains.members, store)
    validation.require_none(members.where("native IS NULL").select("row_id"), "controls in chromosome gaps")
    mixing = diversity.chain_diversity(chains.members, chains.sets)
    summary = diversity.reuse_summary(chains.members).first().asDict()
    total = mixing.agg(F.coalesce(F.sum("membership_ess"), F.lit(0.0))).first()[0]
    publish(
        spark, destination, CONTROLS,
        {
            "members": members,
            "set_cdfs": chains.cdfs,
            "sets": chains.sets.coalesce(1),
            "reuse": diversity.reuse_counts(chains.members),
            "diversity": mixing,
            **(audit or {}),
        },
        {
            **summary, "step": step, "threshold": target.threshold, "set_size": target.size, "seed": seed,
            "config": config, "target": target_identity, "source": source_identity(store),
            "diagnostics": chains.diagnostics, "construction": chains.construction,
            "membership_ess_total": total,
        },
        partition_by={"members": ["chain_index"]},
    )


def check_replicates(bundle: Bundle, size: int) -> None:
    """Counts, members and winners of a bundle of replicate matches agree with each other and with the target's size."""
    counts, members, restarts = (bundle.table(name) for name in ("counts", "members", "restarts"))
    validation.require_none(bootstrap.replicate_sizes(counts).where(F.col("draws") != size), "draws of replicates")
    held = members.groupBy("replicate").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("distinct"))
    validation.require_none(held.where((F.col("n") != size) | (F.col("distinct") != size)), "members of replicates")
    best = bootstrap.best_restart(restarts.select("replicate", "restart", F.col("match_bootstrap").alias("wasserstein")))
    said = bundle.table("replicates").select("replicate", F.col("restart").alias("_restart"), F.col("match_bootstrap").alias("_distance"))
    both = best.join(said, "replicate", "full_outer").join(held, "replicate", "full_outer")
    agree = F.col("restart").eqNullSafe(F.col("_restart")) & F.col("wasserstein").eqNullSafe(F.col("_distance")) & F.col("n").isNotNull()
    validation.require_none(both.where(~agree), "winners of replicates")


def load_target(bundle: Bundle) -> Target:
    """Target of a published bundle, its invariants checked."""
    meta = bundle.metadata
    grid = Grid(meta["bin_width"], meta["bins"])
    rows, curve = bundle.table("rows"), bundle.table("cdf")
    validation.require_none(rows.groupBy("row_id").count().where("count > 1"), "target rows")
    ending = curve.where(F.col("bin") == grid.bins - 1).first()
    if ending is None or abs(ending["target_cdf"] - 1.0) > 1e-5:
        raise ValueError("the target CDF must end at one")
    return Target(
        grid, meta["size"], rows, bundle.table("changes"), curve, bundle.table("distances"),
        bundle.table("strata"), meta["threshold"],
    )
