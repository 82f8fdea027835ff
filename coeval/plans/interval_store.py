"""Build the interval store from tree tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.operators import catalog, parents
from coeval.operators.ranks import POSITION_TILE
from coeval.plans.validation import bad_intervals, require_none
from coeval.session import RunFolder


@dataclass
class IntervalStore:
    sites: DataFrame
    intervals: DataFrame
    status: DataFrame
    draws: int


def interval_store_tables(
    nodes: DataFrame,
    edges: DataFrame,
    draw_sites: DataFrame,
    mutations: DataFrame,
    draws: int,
    run: RunFolder,
    min_usable_fraction: float = 0.1,
    tile: float = POSITION_TILE,
) -> IntervalStore:
    """Tables of the store; only the aged mutations are written on the way.

    Mutations find their position, their parent at that position and the two
    node ages. Coverage counts every mutation; only those with a parent make an
    interval, and each interval carries its site's interval count so that no
    later step has to look it up.
    """
    placed = mutations.join(draw_sites, ["draw_id", "site_id"]).drop("site_id")
    aged = parents.with_ages(parents.mutation_parents(placed, edges, tile), nodes)
    keyed = run.table(
        "aged-mutations",
        aged.select(
            F.col("position").cast("bigint").alias("position"), "draw_id", "mutation_id", "below", "above"
        ),
    )
    present = draw_sites.select(
        "draw_id", F.col("position").cast("bigint").alias("position")
    ).distinct()
    counted = catalog.per_draw_coverage(keyed)
    per_draw = present.join(counted, ["position", "draw_id"], "left").na.fill(0, ["usable", "roots"])
    covered = catalog.site_coverage(per_draw, draws, min_usable_fraction)
    sites = catalog.union_catalog(draw_sites).join(covered, "position")
    ids = sites.select("position", "row_id", "usable_intervals")
    intervals = (
        keyed.where("above IS NOT NULL")
        .join(ids, "position")
        .select("row_id", "draw_id", "mutation_id", "below", "above", "usable_intervals")
    )
    status = (
        catalog.draw_status(per_draw)
        .join(ids.select("position", "row_id"), "position")
        .select("draw_id", "row_id", "status")
    )
    return IntervalStore(sites, intervals, status, draws)


def site_problems(draw_sites: DataFrame) -> DataFrame:
    """Fractional or repeated positions within a draw."""
    fractional = draw_sites.where(F.col("position") != F.floor("position")).select(
        "draw_id", "position", F.lit("fractional position").alias("problem")
    )
    repeated = (
        draw_sites.groupBy("draw_id", "position").count().where("count > 1")
        .select("draw_id", "position", F.lit("repeated position").alias("problem"))
    )
    return fractional.unionByName(repeated)


def check_inputs(
    draw_sites: DataFrame, store: IntervalStore, missing: str = "skip", root: str = "skip"
) -> None:
    """Apply the input policies; only previews reach the driver."""
    for name, value in (("missing", missing), ("root", root)):
        if value not in ("skip", "error"):
            raise ValueError(f"{name} policy must be 'skip' or 'error'")
    require_none(site_problems(draw_sites), "draw sites")
    if missing == "error":
        absent = store.sites.where("missing_draws > 0").select("position", "missing_draws")
        require_none(absent, "positions absent from some draw", 1)
    if root == "error":
        roots = store.sites.where("skipped_roots > 0").select("position", "skipped_roots")
        require_none(roots, "root mutations", 1)
    require_none(bad_intervals(store.intervals), "intervals")
