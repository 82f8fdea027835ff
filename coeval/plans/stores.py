"""Build and publish interval and dense stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators import catalog, cdf, density
from coeval.operators.coordinates import Chromosome, chromosome_frame, validate_chromosomes
from coeval.plans import interval_store, validation
from coeval.schema import CDF_SCALE
from coeval.session import RunFolder, clustered
from coeval.sinks.publish import publish
from coeval.sources.bundles import DENSE_STORE, INTERVAL_STORE, Bundle, source_identity
from coeval.sources.tree_tables import TreeTables


def build_interval_store(
    spark: SparkSession,
    trees: TreeTables,
    chromosomes: list[Chromosome],
    destination: str,
    min_usable_fraction: float = 0.1,
    missing: str = "skip",
    root: str = "skip",
    single_precision: bool = False,
    run: RunFolder | None = None,
) -> None:
    """Tree tables to a published interval store.

    The oldest usable age is taken before any cast to single precision.
    """
    validate_chromosomes(chromosomes)
    store = interval_store.interval_store_tables(
        trees.nodes, trees.edges, trees.sites, trees.mutations, trees.draws,
        run or RunFolder(spark), min_usable_fraction,
    )
    interval_store.check_inputs(trees.sites, store, missing, root)
    oldest = store.intervals.agg(F.max("above")).first()[0]
    facts = store.intervals
    if single_precision:
        facts = facts.withColumns({c: F.col(c).cast("float") for c in ("below", "above")})
        validation.require_none(
            facts.where("above <= below").select("row_id", "draw_id"), "intervals collapse in single precision"
        )
    totals = catalog.coverage_totals(store.sites).first().asDict()
    publish(
        spark, destination, INTERVAL_STORE,
        {
            "sites": clustered(store.sites, "row_id"),
            "intervals": clustered(facts, "row_id", "draw_id", "mutation_id"),
            "status": clustered(store.status, "draw_id", "row_id"),
            "chromosomes": chromosome_frame(spark, chromosomes).coalesce(1),
        },
        {
            "draws": trees.draws, "maximum_above": oldest, "totals": totals,
            "min_usable_fraction": min_usable_fraction,
            "minimum_usable_draws": catalog.required_draws(trees.draws, min_usable_fraction),
            "missing": missing, "root": root,
        },
    )


def validate_interval_store(store: Bundle, deep: bool = False) -> None:
    """Shallow: ids and counters. Deep: intervals, coverage, status, digests."""
    sites, facts = store.table("sites"), store.table("intervals")
    validation.require_none(validation.bad_row_ids(sites), "row ids")
    validation.require_none(validation.bad_position_order(sites), "position order")
    validation.require_none(validation.bad_counters(sites, store.metadata["draws"]), "counters")
    if deep:
        validation.require_none(validation.bad_intervals(facts), "intervals")
        validation.require_none(validation.bad_coverage(sites, facts), "coverage")
        validation.require_none(validation.bad_status(store.table("status"), facts), "status")
        store.verify()


def validate_dense_store(store: Bundle, deep: bool = False) -> None:
    """Shallow: ids and codes. Deep: both layouts hold the same cells, and digests."""
    sites, codes = store.table("sites"), store.table("codes")
    validation.require_none(validation.bad_row_ids(sites), "row ids")
    validation.require_none(validation.bad_codes(codes, store.metadata["bins"], CDF_SCALE, sites), "codes")
    if deep:
        if "codes_by_bin" in store.metadata["tables"]:
            validation.require_none(validation.bad_layouts(codes, store.table("codes_by_bin")), "tiles of the transpose")
        store.verify()


def dense_codes(intervals: DataFrame, grid: Grid) -> DataFrame:
    """(row_id, bin, code) of every site with an interval; point intervals are kept."""
    return density.quantise(cdf.row_grid_cdf(intervals, grid), grid, ["row_id"])


def build_dense_store(
    spark: SparkSession, store: Bundle, bin_width: float, destination: str, transpose: bool = True
) -> None:
    """Quantised CDFs by site and, unless omitted, again by age bin."""
    grid = Grid.spanning(store.metadata["maximum_above"], bin_width)
    codes = RunFolder(spark).table("codes", dense_codes(store.table("intervals"), grid))
    validation.require_none(validation.bad_codes(codes, grid.bins, CDF_SCALE, store.table("sites")), "codes")
    tables = {
        "sites": clustered(store.table("sites"), "row_id"),
        "codes": clustered(codes, "row_id", "bin"),
        "chromosomes": store.table("chromosomes"),
    }
    if transpose:
        tables["codes_by_bin"] = clustered(codes, "bin", "row_id")
    publish(
        spark, destination, DENSE_STORE, tables,
        {
            "draws": store.metadata["draws"], "bin_width": bin_width, "bins": grid.bins,
            "maximum_above": store.metadata["maximum_above"], "source": source_identity(store),
        },
    )
