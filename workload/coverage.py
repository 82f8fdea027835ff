"""Catalog, coverage, status, parents and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from coeval.functions import bits
from coeval.functions.rng import uniform
from coeval.operators import catalog, diversity, parents, ranks, resolution
from coeval.session import RunFolder
from workload import views as v
from workload.registry import register
from workload.views import settle, settle_sql, with_views


@register(
    "a01_union_catalog",
    with_views(["site"], "SELECT row_id, position FROM site"),
)
def union_catalog(spark, folder):
    return catalog.union_catalog(v.mut(spark, folder))


@register(
    "a02_a06_site_coverage",
    with_views(
        ["site"],
        """SELECT position, present_draws, missing_draws, usable_draws, usable_intervals,
           skipped_roots, valid, eligible FROM site""",
    ),
)
def site_coverage(spark, folder):
    return catalog.site_coverage(
        catalog.per_draw_coverage(v.mut(spark, folder)), v.DRAWS, v.USABLE_FRACTION
    )


@register(
    "a07_draw_status",
    with_views(
        ["per_draw"],
        "SELECT draw_id, position, CAST(CASE WHEN usable > 0 THEN 2 ELSE 1 END AS INTEGER) AS status FROM per_draw",
    ),
)
def draw_status(spark, folder):
    return catalog.draw_status(catalog.per_draw_coverage(v.mut(spark, folder)))


@register(
    "a08_maximum_age",
    with_views(["mut"], "SELECT max(above) AS maximum_above FROM mut"),
)
def maximum_age(spark, folder):
    return v.mut(spark, folder).agg(F.max("above").alias("maximum_above"))


@register(
    "a30_coverage_totals",
    with_views(
        ["site"],
        """SELECT CAST(sum(present_draws) AS BIGINT) AS present_draws,
           CAST(sum(missing_draws) AS BIGINT) AS missing_draws,
           CAST(sum(usable_draws) AS BIGINT) AS usable_draws,
           CAST(sum(usable_intervals) AS BIGINT) AS usable_intervals,
           CAST(sum(skipped_roots) AS BIGINT) AS skipped_roots FROM site""",
    ),
)
def coverage_totals(spark, folder):
    return catalog.coverage_totals(v.built_sites(spark, folder))


@register(
    "a31_missing_draws_by_position",
    with_views(
        ["per_draw"],
        f"""SELECT position, CAST(d AS INTEGER) AS draw_id FROM (SELECT DISTINCT position FROM per_draw),
            range(0, {v.DRAWS}) r(d) EXCEPT SELECT position, draw_id FROM per_draw""",
    ),
)
def missing_draws(spark, folder):
    return catalog.missing_pairs(v.mut(spark, folder), list(range(v.DRAWS)))


@register(
    "a34_bucket_statistics",
    with_views(
        ["site"],
        """SELECT CAST(least(floor(row_id * 10 / n), 9) AS INTEGER) AS bucket,
           CAST(sum(usable_intervals) AS BIGINT) AS intervals, count(*) AS rows
           FROM site, (SELECT count(*) AS n FROM site) GROUP BY 1""",
    ),
)
def bucket_statistics(spark, folder):
    sites = v.sites(spark, folder)
    return catalog.bucket_statistics(sites, sites.count(), 10)


@register(
    "p01_p02_valid_eligible",
    with_views(["site"], "SELECT row_id, position FROM site WHERE valid AND eligible"),
)
def eligible(spark, folder):
    return v.built_sites(spark, folder).where("valid AND eligible").select("row_id", "position")


@register(
    "p05_interval_problems",
    with_views(
        ["tiv"],
        """SELECT draw_id, count(*) AS intervals,
           count(*) FILTER (WHERE below < 0 OR above <= below OR isnan(above)) AS problems
           FROM tiv WHERE above IS NOT NULL GROUP BY draw_id""",
    ),
)
def interval_problems(spark, folder):
    from coeval.plans.validation import interval_problem

    mutations = v.tree_mutations(spark, folder).withColumn("position", F.col("site_id"))
    usable = parents.interval_counts(mutations, v.tree_edges(spark, folder), v.tree_nodes(spark, folder), tile=512)
    broken = interval_problem(F.col("below"), F.col("above")).isNotNull()
    return usable.groupBy("draw_id").agg(
        F.sum("times").alias("intervals"),
        F.sum(F.when(broken, F.col("times")).otherwise(0)).alias("problems"),
    )


@register(
    "p07_j09_candidate_universe",
    with_views(["cand"], "SELECT row_id FROM cand"),
)
def candidate_universe(spark, folder):
    return resolution.candidate_universe(v.sites(spark, folder), v.targets(spark, folder))


@register(
    "p15_read_status",
    with_views(
        ["per_draw", "site"],
        f"""SELECT CAST({v.DRAWS - 1} - d AS INTEGER) AS draw_order, CAST(d AS INTEGER) AS draw_id,
            s.row_id, CAST(CASE WHEN p.usable > 0 THEN 2 WHEN p.usable = 0 THEN 1 ELSE 0 END AS INTEGER)
            AS status FROM site s CROSS JOIN range(0, {v.DRAWS}) r(d)
            LEFT JOIN per_draw p ON p.position = s.position AND p.draw_id = d""",
    ),
)
def read_status(spark, folder):
    rows = v.sites(spark, folder).select("row_id", "position")
    status = (
        catalog.draw_status(catalog.per_draw_coverage(v.mut(spark, folder)))
        .join(rows, "position")
        .select("draw_id", "row_id", "status")
    )
    wanted = rows.select(F.col("row_id").alias("row_order"), "row_id")
    return catalog.read_status(status, list(range(v.DRAWS - 1, -1, -1)), wanted).drop("row_order")


@register(
    "f08_packed_status",
    with_views(
        ["per_draw", "site"],
        """SELECT draw_id, CAST(floor(row_id / 4) AS BIGINT) AS byte_idx,
           CAST(sum((CASE WHEN usable > 0 THEN 2 ELSE 1 END) * power(4, row_id % 4)) AS INTEGER) AS packed
           FROM per_draw JOIN site USING (position) GROUP BY 1, 2""",
    ),
)
def packed_status(spark, folder):
    rows = v.sites(spark, folder).select("row_id", "position")
    status = catalog.draw_status(catalog.per_draw_coverage(v.mut(spark, folder))).join(rows, "position")
    return bits.pack_status(status)


@register(
    "f08_unpacked_status",
    with_views(
        ["per_draw", "site"],
        """SELECT CAST(status AS INTEGER) AS status, count(*) AS pairs FROM (
             SELECT CASE WHEN usable > 0 THEN 2 ELSE 1 END AS status FROM per_draw) GROUP BY 1""",
    ),
)
def unpacked_status(spark, folder):
    packed = packed_status(spark, folder)
    rows = v.sites(spark, folder).count()
    unpacked = bits.unpack_status(packed, rows).where("status > 0")
    return unpacked.groupBy("status").agg(F.count("*").alias("pairs"))


@register(
    "u02_catalog_difference",
    with_views(
        ["site"],
        "SELECT position FROM site WHERE position - 1 NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5)",
    ),
)
def catalog_difference(spark, folder):
    small = v.table(spark, folder, "part").where("p_size <= 5").select(
        (F.col("p_partkey") + 1).alias("position")
    )
    return v.sites(spark, folder).select("position").join(small, "position", "left_anti")


@register(
    "w11_coalesced_slabs",
    with_views(
        ["te"],
        """SELECT min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS requested FROM (
             SELECT row_id, sum(opened) OVER (ORDER BY row_id) AS slab FROM (
               SELECT row_id, CASE WHEN row_id - lag(row_id) OVER (ORDER BY row_id) <= 9
                 THEN 0 ELSE 1 END AS opened FROM te)) GROUP BY slab""",
    ),
)
def coalesced_slabs(spark, folder):
    return diversity.coalesced_slabs(v.targets(spark, folder), gap=8)


@register(
    "t01_mutation_order",
    """SELECT draw_id, mutations, CAST(mutations * (mutations - 1) / 2 AS BIGINT) AS ord_sum FROM (
         SELECT l_suppkey AS draw_id, count(*) AS mutations FROM lineitem GROUP BY 1)""",
)
def mutation_order(spark, folder):
    """Ordinals inside each group: 0..n-1 whatever the size of the group."""
    rows = v.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("row_id"),
        F.lit(0).alias("draw_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mutation_id"),
    )
    return (
        catalog.mutation_order(rows)
        .groupBy(F.col("row_id").alias("draw_id"))
        .agg(F.count("*").alias("mutations"), F.sum("ord").alias("ord_sum"))
    )


@register(
    "p03_p04_policy_violations",
    with_views(
        ["site"],
        """SELECT position, missing_draws, skipped_roots FROM site
           WHERE missing_draws > 0 OR skipped_roots > 0""",
    ),
)
def policy_violations(spark, folder):
    """Positions that the strict missing or root policy would refuse."""
    sites = v.built_sites(spark, folder)
    return sites.where("missing_draws > 0 OR skipped_roots > 0").select(
        "position", "missing_draws", "skipped_roots"
    )


@register(
    "t08_stratified_audit_sample",
    f"""SELECT event_id, flagged FROM (SELECT event_id, flagged,
          row_number() OVER (PARTITION BY flagged ORDER BY u, event_id) AS rk,
          count(*) FILTER (WHERE flagged) OVER () AS yes, count(*) FILTER (WHERE NOT flagged) OVER () AS no,
          count(*) OVER () // 2 AS size
          FROM (SELECT event_id, event_type = 'error' AS flagged,
                {v._uniform_sql(f"'{v.SEED}'", "'audit'", "event_id::VARCHAR")} AS u FROM events))
        WHERE rk <= CASE WHEN flagged THEN least(yes, greatest(size // 2, size - no))
          ELSE least(no, size - least(yes, greatest(size // 2, size - no))) END""",
)
def stratified_audit_sample(spark, folder):
    """Half of all events, error events preferred up to one half of the sample."""
    events = v.table(spark, folder, "events").select(
        "event_id",
        (F.col("event_type") == "error").alias("flagged"),
        uniform(v.SEED, "audit", F.col("event_id")).alias("u"),
    )
    sampled = ranks.stratified_sample(events, "flagged", "u", "event_id", events.count() // 2)
    return sampled.select("event_id", "flagged")


# --- Tree tables: as-of parents and interval facts ---------------------------


def _tree_parents(spark, folder):
    mutations = v.tree_mutations(spark, folder).withColumn("position", F.col("site_id"))
    return parents.mutation_parents(mutations, v.tree_edges(spark, folder), tile=512)


def _tree_intervals(spark, folder):
    return parents.with_ages(_tree_parents(spark, folder), v.tree_nodes(spark, folder))


@register(
    "j05_mutation_parents",
    with_views(
        ["tparent"],
        """SELECT draw_id, node_id, count(*) AS mutations, count(parent) AS covered,
           CAST(sum(parent) AS BIGINT) AS parent_sum FROM tparent GROUP BY draw_id, node_id""",
    ),
)
def mutation_parents(spark, folder):
    return (
        _tree_parents(spark, folder)
        .groupBy("draw_id", "node_id")
        .agg(
            F.count("*").alias("mutations"),
            F.count("parent").alias("covered"),
            F.sum("parent").alias("parent_sum"),
        )
    )


@register(
    "j05b_fractional_breakpoints",
    with_views(
        [],
        """SELECT draw_id, count(*) AS mutations, count(parent) AS covered,
           CAST(sum(parent) AS BIGINT) AS parent_sum FROM (
             SELECT m.*, e.parent FROM tmut m LEFT JOIN shifted e ON e.draw_id = m.draw_id
             AND e.child = m.node_id AND e.lft <= m.position AND m.position < e.rgt)
           GROUP BY draw_id""",
        {
            "edge": v.CTES["edge"][1],
            "tmut": v.CTES["tmut"][1],
            "shifted": """SELECT draw_id, child, parent, "left" + 0.5::DOUBLE AS lft,
                          "right" + 0.5::DOUBLE AS rgt FROM edge""",
        },
    ),
)
def fractional_breakpoints(spark, folder):
    edges = v.tree_edges(spark, folder).withColumns(
        {"left": F.col("left") + 0.5, "right": F.col("right") + 0.5}
    )
    mutations = v.tree_mutations(spark, folder).withColumn("position", F.col("site_id"))
    return (
        parents.mutation_parents(mutations, edges, tile=512)
        .groupBy("draw_id")
        .agg(
            F.count("*").alias("mutations"),
            F.count("parent").alias("covered"),
            F.sum("parent").alias("parent_sum"),
        )
    )


@register(
    "j06_j07_tree_intervals",
    with_views(
        ["tiv"],
        f"""SELECT position, draw_id, count(*) AS mutations, count(above) AS usable,
            {settle_sql('sum(above - below)', 3)} AS total_width FROM tiv GROUP BY position, draw_id""",
    ),
)
def tree_intervals(spark, folder):
    return (
        _tree_intervals(spark, folder)
        .groupBy("position", "draw_id")
        .agg(
            F.count("*").alias("mutations"),
            F.count("above").alias("usable"),
            settle(F.sum(F.col("above") - F.col("below")), 3).alias("total_width"),
        )
    )


@register(
    "q1_interval_store_build",
    with_views(
        ["tiv"],
        f"""SELECT row_number() OVER (ORDER BY position) - 1 AS row_id, position, present_draws,
            5 - present_draws AS missing_draws, usable_draws, usable_intervals, skipped_roots,
            usable_draws >= 3 AS eligible, mean_age FROM (
              SELECT position, count(DISTINCT draw_id) AS present_draws,
                count(DISTINCT draw_id) FILTER (WHERE above IS NOT NULL) AS usable_draws,
                count(above) AS usable_intervals, count(*) - count(above) AS skipped_roots,
                {settle_sql('avg((below + above) / 2) FILTER (WHERE above IS NOT NULL)', 4)} AS mean_age
              FROM tiv GROUP BY position)""",
    ),
)
def interval_store_build(spark, folder):
    """The whole build on tree tables: catalog, parents, ages, coverage."""
    from coeval.operators.cdf import mean_age
    from coeval.plans.interval_store import interval_store_tables

    store = interval_store_tables(
        nodes=v.tree_nodes(spark, folder),
        edges=v.tree_edges(spark, folder),
        draw_sites=v.tree_sites(spark, folder),
        mutations=v.tree_mutations(spark, folder),
        draws=5,
        run=RunFolder(spark),
        min_usable_fraction=0.6,
        tile=512,
    )
    ages = mean_age(store.intervals).withColumn("mean_age", settle(F.col("mean_age"), 4))
    return store.sites.join(ages, "row_id", "left").select(
        "row_id", "position", "present_draws", "missing_draws", "usable_draws",
        "usable_intervals", "skipped_roots", "eligible", "mean_age",
    )


@register(
    "v09_parent_audit",
    with_views([], "SELECT 0::BIGINT AS mismatches, count(*) AS audited FROM tmut", {"tmut": v.CTES["tmut"][1]}),
)
def parent_audit(spark, folder):
    """As-of parents against a direct interval test, over every mutation."""
    looked_up = _tree_parents(spark, folder)
    mutations = v.tree_mutations(spark, folder).withColumn("position", F.col("site_id"))
    wrong = parents.parent_audit(mutations, v.tree_edges(spark, folder), looked_up, tile=64)
    return mutations.agg(F.count("*").alias("audited")).select(
        F.lit(wrong.count()).cast("bigint").alias("mismatches"), "audited"
    )
