"""Coordinates, requests and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from coeval.operators import coordinates, resolution
from workload import views as v
from workload.registry import register
from workload.views import settle, settle_sql, with_views


def _resolved(spark, folder):
    return resolution.resolve(v.requests(spark, folder), v.sites(spark, folder))


@register(
    "j01_j02_resolve_positions",
    with_views(["resolved"], "SELECT position, row_id, resolved, eligible, reason FROM resolved"),
)
def resolve_positions(spark, folder):
    return _resolved(spark, folder)


@register(
    "a29_resolution_summary",
    with_views(
        ["resolved"],
        f"""SELECT count(*) AS requested, count(*) FILTER (WHERE resolved) AS resolved,
            count(*) FILTER (WHERE NOT resolved) AS unresolved,
            count(*) FILTER (WHERE eligible) AS eligible,
            count(*) FILTER (WHERE resolved AND NOT eligible) AS ineligible,
            count(*) FILTER (WHERE NOT eligible) AS excluded,
            {settle_sql("count(*) FILTER (WHERE resolved) / count(*)::DOUBLE", 8)} AS resolved_fraction,
            {settle_sql("count(*) FILTER (WHERE eligible) / count(*)::DOUBLE", 8)} AS eligible_fraction
            FROM resolved""",
    ),
)
def resolution_summary(spark, folder):
    return resolution.summarize(_resolved(spark, folder)).withColumns(
        {c: settle(F.col(c), 8) for c in ("resolved_fraction", "eligible_fraction")}
    )


@register(
    "p16_p17_excluded_requests",
    with_views(["resolved"], "SELECT position, reason FROM resolved WHERE NOT eligible"),
)
def excluded_requests(spark, folder):
    return resolution.view(_resolved(spark, folder), "excluded").select("position", "reason")


@register(
    "p06_drop_policy",
    with_views(["resolved"], "SELECT position, row_id FROM resolved WHERE eligible"),
)
def drop_policy(spark, folder):
    return resolution.enforce_policy(_resolved(spark, folder), "drop").select("position", "row_id")


@register(
    "p19_duplicate_requests",
    """SELECT l_partkey + 1 AS position, count(*) AS times FROM lineitem
       GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_requests(spark, folder):
    line = v.table(spark, folder, "lineitem")
    return resolution.duplicate_requests(line.select((F.col("l_partkey") + 1).alias("position")))


@register(
    "s09_candidate_problems",
    with_views(
        ["site"],
        """SELECT row_id, problem FROM (SELECT r.row_id,
             CASE WHEN s.row_id IS NULL THEN 'out of range' WHEN r.times > 1 THEN 'duplicate'
                  WHEN NOT s.eligible THEN 'ineligible' END AS problem
             FROM (SELECT ps AS row_id, count(*) AS times FROM (
                     SELECT p_partkey AS ps FROM part UNION ALL SELECT -1 - s_suppkey FROM supplier
                     UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1) r
             LEFT JOIN site s USING (row_id)) WHERE problem IS NOT NULL""",
    ),
)
def candidate_problems(spark, folder):
    suppliers = v.table(spark, folder, "supplier")
    listed = (
        v.table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"))
        .unionByName(suppliers.select((-1 - F.col("s_suppkey")).alias("row_id")))
        .unionByName(suppliers.select(F.col("s_suppkey").alias("row_id")))
    )
    return resolution.candidate_problems(v.sites(spark, folder), listed)


_NATIVE_SQL = """SELECT p.position, c.chrom, p.position - c."offset" AS native
   FROM (SELECT p_partkey + 1 AS position FROM part) p
   LEFT JOIN chrom c ON p.position > c."offset" AND p.position <= c."offset" + c.length"""


@register("j04_global_to_native", with_views(["chrom"], _NATIVE_SQL))
def global_to_native(spark, folder):
    """Every position to its chromosome; gap bases have none."""
    sites = v.table(spark, folder, "part").select((F.col("p_partkey") + 1).alias("position"))
    return coordinates.global_to_native(sites, v.chromosomes(spark, folder))


def _native_requests(spark, folder):
    """Each customer asks for its own key on the chromosome of its nation."""
    return v.table(spark, folder, "customer").select(
        F.concat(F.lit("chr"), F.col("c_nationkey") + 2).alias("chrom"),
        (F.col("c_custkey") % 90).alias("native"),
    )


@register(
    "j03_native_to_global",
    with_views(
        ["chrom"],
        """SELECT chrom, native, CASE WHEN "offset" IS NULL THEN 'unknown chromosome'
             WHEN native NOT BETWEEN 1 AND length THEN 'position out of range' END AS problem,
           CASE WHEN native BETWEEN 1 AND length THEN "offset" + native END AS position
           FROM (SELECT 'chr' || (c_nationkey + 2) AS chrom, c_custkey % 90 AS native FROM customer)
           LEFT JOIN chrom USING (chrom)""",
    ),
)
def native_to_global(spark, folder):
    return coordinates.native_to_global(_native_requests(spark, folder), v.chromosomes(spark, folder))


@register(
    "j18_resolve_native",
    with_views(
        ["chrom", "site"],
        """SELECT chrom, native, s.row_id, s.row_id IS NOT NULL AS resolved FROM (
             SELECT chrom, native, CASE WHEN native BETWEEN 1 AND length THEN "offset" + native END
             AS position FROM (SELECT 'chr' || (c_nationkey + 2) AS chrom, c_custkey % 90 AS native
             FROM customer) LEFT JOIN chrom USING (chrom)) LEFT JOIN site s USING (position)""",
    ),
)
def resolve_native(spark, folder):
    placed = native_to_global(spark, folder)
    return resolution.resolve(placed, v.sites(spark, folder)).select(
        "chrom", "native", "row_id", "resolved"
    )


@register(
    "j17_requested_intervals",
    with_views(
        ["iv"],
        """SELECT request_index, row_id, count(below) AS intervals, sum(above - below) AS width
           FROM (SELECT o_orderkey AS request_index, o_custkey AS row_id FROM orders)
           LEFT JOIN iv USING (row_id) GROUP BY ALL""",
    ),
)
def requested_intervals(spark, folder):
    """Every customer key asked for once per order; absent sites give empty groups."""
    wanted = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_index"), F.col("o_custkey").alias("row_id")
    )
    return resolution.gather_summaries(wanted, v.intervals(spark, folder))


@register(
    "j17_t06_ragged_intervals",
    with_views(
        ["site"],
        """SELECT request_index, row_id, CAST(CASE WHEN below IS NOT NULL THEN row_number() OVER (PARTITION BY request_index ORDER BY draw_id, mutation_id) - 1 END AS INTEGER) AS place,
           draw_id, below, above
           FROM (SELECT c_custkey AS request_index, c_custkey * 7 % 3000 AS row_id FROM customer)
           LEFT JOIN (SELECT row_id, CAST(l_suppkey % 8 AS INTEGER) AS draw_id, l_orderkey * 8 + l_linenumber AS mutation_id, l_quantity * 1000.0::DOUBLE AS below,
             l_quantity * 1000.0::DOUBLE + 1000.0::DOUBLE + l_discount * 100000.0::DOUBLE AS above
             FROM lineitem JOIN site ON position = l_partkey + 1 WHERE l_returnflag <> 'R') USING (row_id)""",
    ),
)
def ragged_intervals(spark, folder):
    """The intervals that every customer asks for, in order; rows beyond the catalog have none."""
    line = v.table(spark, folder, "lineitem").where("l_returnflag <> 'R'")
    below = F.col("l_quantity") * 1000.0
    facts = line.select(
        (F.col("l_partkey") + 1).alias("position"), (F.col("l_suppkey") % v.DRAWS).cast("int").alias("draw_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mutation_id"), below.alias("below"),
        (below + 1000.0 + F.col("l_discount") * 100000.0).alias("above"),
    ).join(v.sites(spark, folder).select("position", "row_id"), "position")
    wanted = v.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("request_index"), (F.col("c_custkey") * 7 % 3000).alias("row_id")
    )
    found = resolution.gather_intervals(wanted, facts, piece=8)
    each = found.select("request_index", "row_id", "piece", F.posexplode_outer("intervals").alias("at", "i"))
    return each.select("request_index", "row_id", (F.col("piece") * 8 + F.col("at")).alias("place"), "i.draw_id", "i.below", "i.above")


@register(
    "s09_candidates_from_positions",
    with_views(["resolved"], "SELECT row_id FROM resolved WHERE eligible"),
)
def candidates_from_positions(spark, folder):
    return resolution.candidates_at(v.sites(spark, folder), v.requests(spark, folder), "drop")


@register(
    "s09_candidates_from_mask",
    with_views(["site"], "SELECT row_id FROM site WHERE usable_intervals > 15"),
)
def candidates_from_mask(spark, folder):
    sites = v.sites(spark, folder)
    mask = sites.select("row_id", (F.col("usable_intervals") > 15).alias("selected"))
    return resolution.candidates_marked(sites, mask)
