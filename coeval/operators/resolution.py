"""Resolve requested positions against the site catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.operators.ranks import ordinal_in_group


def resolve(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """Left join with the three outcomes of a request.

    Adds ``row_id`` (NULL when unresolved), ``resolved``, ``eligible`` and
    ``reason``; request columns, native coordinates included, pass through.
    """
    catalog = sites.select("position", "row_id", F.col("eligible").alias("_eligible"))
    resolved = F.col("row_id").isNotNull()
    eligible = F.coalesce(F.col("_eligible"), F.lit(False))
    reason = F.when(~resolved, F.lit("unresolved")).when(~eligible, F.lit("ineligible"))
    return (
        requests.join(catalog, "position", "left")
        .withColumns({"resolved": resolved, "eligible": eligible, "reason": reason})
        .drop("_eligible")
    )


def summarize(resolution: DataFrame) -> DataFrame:
    """The eight resolution counters and fractions, one row."""
    requested = F.count("*")
    eligible = F.count_if("eligible")
    share = lambda c: F.coalesce(F.try_divide(c, requested), F.lit(0.0))
    return resolution.agg(
        requested.alias("requested"),
        F.count_if("resolved").alias("resolved"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        eligible.alias("eligible"),
        F.count_if(F.col("resolved") & ~F.col("eligible")).alias("ineligible"),
        F.count_if(~F.col("eligible")).alias("excluded"),
        share(F.count_if("resolved")).alias("resolved_fraction"),
        share(eligible).alias("eligible_fraction"),
    )


def view(resolution: DataFrame, name: str) -> DataFrame:
    """Rows of one outcome: included, unresolved, ineligible or excluded."""
    conditions = {
        "included": F.col("eligible"),
        "unresolved": ~F.col("resolved"),
        "ineligible": F.col("resolved") & ~F.col("eligible"),
        "excluded": ~F.col("eligible"),
    }
    if name not in conditions:
        raise ValueError(f"unknown resolution view {name!r}")
    return resolution.where(conditions[name])


def enforce_policy(resolution: DataFrame, policy: str) -> DataFrame:
    """Apply the missing-position policy and return the included requests.

    ``error`` accepts no exclusion at all; ``drop`` needs at least one included
    row. Only counters and a ten-row preview reach the driver.
    """
    if policy not in ("error", "drop"):
        raise ValueError("policy must be 'error' or 'drop'")
    counts = summarize(resolution).first()
    if counts["excluded"] and policy == "error":
        preview = view(resolution, "excluded").select("position", "reason").limit(10).collect()
        raise ValueError(
            f"{counts['unresolved']} unresolved and {counts['ineligible']} ineligible "
            f"positions, first: {[(r['position'], r['reason']) for r in preview]}"
        )
    if not counts["eligible"]:
        raise ValueError("no eligible positions remain")
    return view(resolution, "included")


def duplicate_requests(requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests made more than once."""
    keys = keys or ["position"]
    return requests.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def candidate_universe(
    sites: DataFrame, targets: DataFrame, candidates: DataFrame | None = None
) -> DataFrame:
    """Eligible ``row_id`` values, optionally restricted, never a target."""
    pool = sites.where("eligible").select("row_id")
    if candidates is not None:
        pool = pool.join(candidates.select("row_id"), "row_id", "left_semi")
    return pool.join(targets.select("row_id"), "row_id", "left_anti")


def candidate_problems(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """Declared candidates that are repeated, out of range or ineligible."""
    counted = candidates.groupBy("row_id").agg(F.count("*").alias("times"))
    joined = counted.join(sites.select("row_id", "eligible"), "row_id", "left")
    problem = (
        F.when(F.col("eligible").isNull(), F.lit("out of range"))
        .when(F.col("times") > 1, F.lit("duplicate"))
        .when(~F.col("eligible"), F.lit("ineligible"))
    )
    return joined.select("row_id", problem.alias("problem")).where("problem IS NOT NULL")


#: Intervals of one piece of a request's answer.
PIECE = 1_024


def gather_intervals(requests: DataFrame, intervals: DataFrame, piece: int = PIECE) -> DataFrame:
    """(request_index, row_id, piece, intervals): what every request asked for, in request order.

    Requests (request_index, row_id) may repeat rows, and each has its own answer;
    one for a row without intervals has an empty array. Intervals are structs
    (draw_id, mutation_id, below, above) in order of draw and mutation. A site's
    arrays are made once, before requests meet them, in pieces of at most
    ``piece`` intervals, so neither a busy site nor a wanted one is ever held
    whole. Partitions are ranges of requests, sorted: written files are in order.
    """
    wanted = requests.select("row_id").distinct()
    own = intervals.join(wanted, "row_id", "left_semi").select("row_id", "draw_id", "mutation_id", "below", "above")
    placed = ordinal_in_group(own, ["row_id"], ["draw_id", "mutation_id"], "mutation_id")
    held = placed.groupBy("row_id", F.floor(F.col("ord") / piece).cast("int").alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("draw_id", "mutation_id", "below", "above"))).alias("intervals")
    )
    met = requests.select("request_index", "row_id").join(held, "row_id", "left")
    none = F.array().cast(held.schema["intervals"].dataType)
    answers = met.select("request_index", "row_id", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("intervals", none).alias("intervals"))
    return answers.repartitionByRange("request_index", "piece").sortWithinPartitions("request_index", "piece")


def gather_summaries(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Interval count and total width per request.

    Sites are reduced before the join, so a busy site asked for many times
    costs one row per request.
    """
    per_site = intervals.groupBy("row_id").agg(
        F.count("*").alias("intervals"), F.sum(F.col("above") - F.col("below")).alias("width")
    )
    joined = requests.join(per_site, "row_id", "left")
    return joined.withColumn("intervals", F.coalesce("intervals", F.lit(0)))


def candidates_at(sites: DataFrame, positions: DataFrame, policy: str = "error") -> DataFrame:
    """Candidate rows from a list of global positions, under the missing policy."""
    return enforce_policy(resolve(positions, sites), policy).select("row_id")


def candidates_marked(sites: DataFrame, mask: DataFrame) -> DataFrame:
    """Candidate rows from a mask table (row_id, selected) with every catalog row once."""
    times = sites.select("row_id", F.lit(1).alias("_site")).join(
        mask.groupBy("row_id").agg(F.count("*").alias("_marks")), "row_id", "full"
    )
    if not times.where("_site IS NULL OR _marks IS NULL OR _marks <> 1").isEmpty():
        raise ValueError("the mask must hold every catalog row once and nothing else")
    return mask.where("selected").select("row_id")
