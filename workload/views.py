"""The given tables seen as genealogy data.

Every view exists twice: as a DataFrame built with the library, and as a
common table expression for the SQL check. Nothing is filtered away: each view
covers its whole source tables.

* a line item is a mutation of one of eight posterior draws at position
  ``l_partkey + 1``; returned items (flag R) are root mutations;
* a customer's orders are the parents of the customer node over time, each
  order reigning until the next one;
* the 25 nations are chromosomes that cut the positions evenly, with one gap
  base between neighbours.
"""

from __future__ import annotations

import hashlib
import threading
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.functions.rng import uniform
from coeval.operators import catalog, cdf
from coeval.session import RunFolder, clustered, fit_shuffles, shared_folder

DRAWS = 8
USABLE_FRACTION = 0.85
REQUIRED_DRAWS = 7
WIDTH = 1000.0
COARSE_WIDTH = 8000.0
SEED = 20240501
TARGET_MAX_SIZE = 5


_ROWS: dict[tuple[str, str, str], int] = {}


def _fit(spark: SparkSession, folder: str, name: str) -> None:
    """Fit the session's shuffles to a given table, counted once from its footers."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _ROWS:
        _ROWS[key] = spark.read.parquet(f"{folder}/{name}.parquet").count()
    fit_shuffles(spark, _ROWS[key])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    _fit(spark, folder, name)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(column, digits: int):
    """Round for comparison, nudged so that exact halves fall the same way."""
    return F.round(column + F.lit(0.0137 * 10.0**-digits), digits)


def settle_sql(expression: str, digits: int) -> str:
    return f"round(({expression}) + {0.0137 * 10.0**-digits!r}::DOUBLE, {digits})"


# --- mutations with ages taken from the line itself -------------------------


def mut(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    below = F.col("l_quantity") * 1000.0
    root = F.col("l_returnflag") == "R"
    return line.select(
        (F.col("l_suppkey") % DRAWS).cast("int").alias("draw_id"),
        (F.col("l_partkey") + 1).alias("position"),
        below.alias("below"),
        F.when(~root, below + 1000.0 + F.col("l_discount") * 100000.0).alias("above"),
    )


_BUILDING = threading.RLock()


def stored(name: str, *keys: str):
    """Write a view once per application and data folder, then read it back.

    The engine's operators read a built store and ready tree tables; this is
    that store for the given tables. Queries on the build itself call the
    ``built_`` functions. ``keys`` cluster a large table.
    """

    def wrap(build):
        @wraps(build)
        def read(spark: SparkSession, folder: str) -> DataFrame:
            identity = hashlib.sha256(folder.encode()).hexdigest()[:12]
            application = spark.sparkContext.applicationId
            run = RunFolder(spark)
            run.path, run.resume = f"{shared_folder(spark)}/store-{application}-{identity}", True
            _fit(spark, folder, "lineitem")
            make = lambda: clustered(build(spark, folder), *keys) if keys else build(spark, folder)
            with _BUILDING:
                return run.table(name, make)

        return read

    return wrap


def built_sites(spark: SparkSession, folder: str) -> DataFrame:
    facts = mut(spark, folder)
    covered = catalog.site_coverage(catalog.per_draw_coverage(facts), DRAWS, USABLE_FRACTION)
    return catalog.union_catalog(facts).join(covered, "position")


sites = stored("sites", "row_id")(built_sites)


def built_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Usable intervals keyed by ``row_id``, with each site's interval count."""
    facts = mut(spark, folder).where("above IS NOT NULL")
    counted = sites(spark, folder).select("row_id", "position", "usable_intervals")
    return facts.join(counted, "position").select(
        "row_id", "draw_id", "below", "above", "usable_intervals"
    )


intervals = stored("intervals", "row_id", "draw_id", "below")(built_intervals)


def maximum_above(spark: SparkSession, folder: str) -> float:
    return intervals(spark, folder).agg(F.max("above")).first()[0]


def grid(spark: SparkSession, folder: str, width: float = WIDTH) -> Grid:
    return Grid.spanning(maximum_above(spark, folder), width)


@stored("targets")
def targets(spark: SparkSession, folder: str) -> DataFrame:
    small = table(spark, folder, "part").where(F.col("p_size") <= TARGET_MAX_SIZE)
    wanted = small.select((F.col("p_partkey") + 1).alias("position"))
    return sites(spark, folder).where("eligible").join(wanted, "position", "left_semi").select("row_id")


@stored("candidates")
def candidates(spark: SparkSession, folder: str) -> DataFrame:
    eligible = sites(spark, folder).where("eligible").select("row_id")
    return eligible.join(targets(spark, folder), "row_id", "left_anti")


def chromosomes(spark: SparkSession, folder: str) -> DataFrame:
    """25 equal stretches of the positions, the last base of each a gap."""
    nations = table(spark, folder, "nation")
    span = table(spark, folder, "part").agg(
        F.ceil((F.max("p_partkey") + 1) / 25.0).cast("bigint").alias("span")
    ).first()["span"]
    return nations.select(
        F.concat(F.lit("chr"), F.col("n_nationkey") + 1).alias("chrom"),
        (F.col("n_nationkey").cast("bigint") * span).alias("offset"),
        F.lit(span - 1).cast("bigint").alias("length"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Small parts, eligible or not, plus positions past the catalog."""
    part = table(spark, folder, "part")
    small = part.where(F.col("p_size") <= TARGET_MAX_SIZE).select(
        (F.col("p_partkey") + 1).alias("position")
    )
    past = table(spark, folder, "supplier").select((-1 - F.col("s_suppkey")).alias("position"))
    return small.unionByName(past)


def site_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, k, n): derived and callable calls per position."""
    line = table(spark, folder, "lineitem")
    called = F.col("l_tax") > 0
    return line.groupBy(F.col("l_partkey").alias("row_id")).agg(
        F.count_if(called & (F.col("l_linestatus") == "F")).alias("k"),
        F.count_if(called).alias("n"),
    )


SETS = 6


@stored("control-sets")
def control_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(chain_index, sample_index, row_id): six overlapping candidate sets.

    A candidate joins a set when its counter draw for that set is below 0.12.
    """
    numbered = candidates(spark, folder).select(
        "row_id", F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))).alias("set_id")
    )
    return numbered.where(uniform(SEED, "set", F.col("set_id"), F.col("row_id")) < 0.12).select(
        F.floor(F.col("set_id") / 3).cast("int").alias("chain_index"),
        (F.col("set_id") % 3).cast("int").alias("sample_index"),
        "row_id",
    )


def target_cdf(spark: SparkSession, folder: str, age_grid: Grid, facts: DataFrame) -> DataFrame:
    """Mean CDF of the target rows as (bin, target_cdf)."""
    changes = cdf.row_changes(facts.join(targets(spark, folder), "row_id", "left_semi"), age_grid)
    whole = cdf.set_cdf(
        targets(spark, folder).withColumn("set_id", F.lit(0)), changes, age_grid, ["set_id"]
    )
    return whole.select("bin", F.col("cdf").alias("target_cdf"))


# --- tree tables --------------------------------------------------------------


def day(column):
    return F.unix_date(F.to_date(column)).cast("bigint")


PARENT_BASE = 1_000_000_000_000


def tree_draws(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, draw_id): a customer belongs to the draw of its region."""
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("draw_id")
    )
    return table(spark, folder, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("node_id"), "draw_id", "c_acctbal"
    )


@stored("tree-nodes")
def tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers are young nodes; orders are their older parents."""
    owners = tree_draws(spark, folder)
    young = owners.select(
        "draw_id", "node_id", F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("time")
    )
    old = (
        table(spark, folder, "orders")
        .withColumn("node_id", F.col("o_custkey"))
        .join(owners, "node_id")
        .select(
            "draw_id",
            (F.col("o_orderkey") + F.lit(PARENT_BASE)).alias("node_id"),
            (F.lit(10000.0) + F.col("o_totalprice")).alias("time"),
        )
    )
    return young.unionByName(old)


@stored("tree-edges")
def tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Each order reigns from its date to the customer's next order.

    Every seventh order ends half-way, leaving uncovered stretches and
    fractional breakpoints.
    """
    dated = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("child"), day("o_orderdate").alias("left"))
        .agg(F.max("o_orderkey").alias("key"))
    )
    following = F.lead("left").over(W.partitionBy("child").orderBy("left"))
    spans = dated.withColumn("next", F.coalesce(following, F.col("left") + 365))
    half = F.col("left") + (F.col("next") - F.col("left")) / 2.0
    right = F.when(F.col("key") % 7 == 0, half).otherwise(F.col("next").cast("double"))
    owners = tree_draws(spark, folder).select(F.col("node_id").alias("child"), "draw_id")
    return spans.join(owners, "child").select(
        "draw_id",
        F.col("left").cast("double").alias("left"),
        right.alias("right"),
        (F.col("key") + F.lit(PARENT_BASE)).alias("parent"),
        "child",
    )


@stored("tree-mutations")
def tree_mutations(spark: SparkSession, folder: str) -> DataFrame:
    """A line item mutates the customer's node at its ship date."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("node_id")
    )
    # Orders meet their owners first, so the longest table is joined once.
    owned = orders.join(tree_draws(spark, folder).select("node_id", "draw_id"), "node_id")
    return (
        table(spark, folder, "lineitem")
        .join(owned, "l_orderkey")
        .select(
            "draw_id",
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mutation_id"),
            day("l_shipdate").alias("site_id"),
            "node_id",
        )
    )


@stored("tree-sites")
def tree_sites(spark: SparkSession, folder: str) -> DataFrame:
    return tree_mutations(spark, folder).select("draw_id", "site_id").distinct().withColumn(
        "position", F.col("site_id").cast("double")
    )


# --- SQL twins ----------------------------------------------------------------


def _uniform_sql(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({joined}), 1, 12))::BIGINT)::DOUBLE / {float(16**12)!r}"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "mut": (
        (),
        """SELECT CAST(l_suppkey % 8 AS INTEGER) AS draw_id, l_partkey + 1 AS position,
           l_quantity * 1000.0::DOUBLE AS below,
           CASE WHEN l_returnflag <> 'R'
                THEN l_quantity * 1000.0::DOUBLE + 1000.0::DOUBLE + l_discount * 100000.0::DOUBLE
           END AS above FROM lineitem""",
    ),
    "per_draw": (
        ("mut",),
        """SELECT position, draw_id, count(above) AS usable, count(*) - count(above) AS roots
           FROM mut GROUP BY position, draw_id""",
    ),
    "site": (
        ("per_draw",),
        f"""SELECT row_number() OVER (ORDER BY position) - 1 AS row_id, *,
            usable_intervals > 0 AS valid,
            usable_intervals > 0 AND usable_draws >= {REQUIRED_DRAWS} AS eligible
            FROM (SELECT position, count(*) AS present_draws, {DRAWS} - count(*) AS missing_draws,
                  count(*) FILTER (WHERE usable > 0) AS usable_draws,
                  CAST(sum(usable) AS BIGINT) AS usable_intervals,
                  CAST(sum(roots) AS BIGINT) AS skipped_roots
                  FROM per_draw GROUP BY position)""",
    ),
    "iv": (
        ("mut", "site"),
        """SELECT s.row_id, m.draw_id, m.below, m.above, s.usable_intervals
           FROM mut m JOIN site s USING (position) WHERE m.above IS NOT NULL""",
    ),
    "te": (
        ("site",),
        f"""SELECT row_id FROM site WHERE eligible AND position - 1 IN
            (SELECT p_partkey FROM part WHERE p_size <= {TARGET_MAX_SIZE})""",
    ),
    "cand": (
        ("site", "te"),
        "SELECT row_id FROM site WHERE eligible AND row_id NOT IN (SELECT row_id FROM te)",
    ),
    "grid": (
        ("mut",),
        f"""SELECT CAST(b AS INTEGER) AS bin, b * {WIDTH!r}::DOUBLE AS center,
            b * {WIDTH!r}::DOUBLE + {WIDTH / 2!r}::DOUBLE AS point, last
            FROM (SELECT greatest(1, CAST(floor(max(above) / {WIDTH!r} + 0.5) AS BIGINT)) AS last
                  FROM mut), range(0, 1000) r(b) WHERE b <= last""",
    ),
    "coarse": (
        ("mut",),
        f"""SELECT CAST(b AS INTEGER) AS bin, b * {COARSE_WIDTH!r}::DOUBLE AS center,
            b * {COARSE_WIDTH!r}::DOUBLE + {COARSE_WIDTH / 2!r}::DOUBLE AS point, last
            FROM (SELECT greatest(1, CAST(floor(max(above) / {COARSE_WIDTH!r} + 0.5) AS BIGINT)) AS last
                  FROM mut), range(0, 1000) r(b) WHERE b <= last""",
    ),
    "row_cdf": (
        ("iv", "grid"),
        """SELECT row_id, bin,
           avg(greatest(0.0, least(1.0, (point - below) / (above - below)))) AS cdf
           FROM iv, grid GROUP BY row_id, bin""",
    ),
    "target_cdf": (
        ("row_cdf", "te"),
        """SELECT bin, avg(cdf) AS target_cdf FROM row_cdf SEMI JOIN te USING (row_id)
           GROUP BY bin""",
    ),
    "chrom": (
        (),
        """SELECT 'chr' || (n_nationkey + 1) AS chrom, n_nationkey::BIGINT * span AS "offset",
           span - 1 AS length FROM nation,
           (SELECT CAST(ceil((max(p_partkey) + 1) / 25.0) AS BIGINT) AS span FROM part)""",
    ),
    "req": (
        (),
        f"""SELECT p_partkey + 1 AS position FROM part WHERE p_size <= {TARGET_MAX_SIZE}
            UNION ALL SELECT -1 - s_suppkey FROM supplier""",
    ),
    "resolved": (
        ("req", "site"),
        """SELECT r.position, s.row_id, s.row_id IS NOT NULL AS resolved,
           coalesce(s.eligible, false) AS eligible,
           CASE WHEN s.row_id IS NULL THEN 'unresolved' WHEN NOT s.eligible THEN 'ineligible' END
           AS reason FROM req r LEFT JOIN site s USING (position)""",
    ),
    "counts": (
        (),
        """SELECT l_partkey AS row_id, count(*) FILTER (WHERE l_tax > 0 AND l_linestatus = 'F') AS k,
           count(*) FILTER (WHERE l_tax > 0) AS n FROM lineitem GROUP BY l_partkey""",
    ),
    "sets": (
        ("cand",),
        f"""SELECT CAST(floor(set_id / 3) AS INTEGER) AS chain_index,
            CAST(set_id % 3 AS INTEGER) AS sample_index, row_id
            FROM cand, range(0, {SETS}) r(set_id)
            WHERE {_uniform_sql(f"'{SEED}'", "'set'", "set_id::VARCHAR", "row_id::VARCHAR")} < 0.12""",
    ),
    "set_cdf": (
        ("sets", "row_cdf"),
        """SELECT chain_index, sample_index, bin, avg(cdf) AS cdf
           FROM sets JOIN row_cdf USING (row_id) GROUP BY ALL""",
    ),
    "set_w1": (
        ("set_cdf", "target_cdf", "grid"),
        f"""SELECT chain_index, sample_index,
            sum(abs(cdf - target_cdf) * {WIDTH!r}::DOUBLE) AS wasserstein
            FROM set_cdf JOIN target_cdf USING (bin) JOIN grid USING (bin)
            WHERE bin < last GROUP BY ALL""",
    ),
    "edge": (
        (),
        f"""SELECT n_regionkey AS draw_id, child, lft::DOUBLE AS "left",
            CASE WHEN key % 7 = 0 THEN lft + (nxt - lft) / 2.0::DOUBLE ELSE nxt::DOUBLE END AS "right",
            key + {PARENT_BASE} AS parent FROM (
              SELECT child, lft, key,
                coalesce(lead(lft) OVER (PARTITION BY child ORDER BY lft), lft + 365) AS nxt FROM (
                SELECT o_custkey AS child,
                  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS lft,
                  max(o_orderkey) AS key FROM orders GROUP BY ALL))
            JOIN customer ON c_custkey = child JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "tmut": (
        (),
        """SELECT n_regionkey AS draw_id, l_orderkey * 8 + l_linenumber AS mutation_id,
           date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS position,
           o_custkey AS node_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
           JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "tparent": (
        ("tmut", "edge"),
        """SELECT m.*, e.parent FROM tmut m LEFT JOIN edge e
           ON e.draw_id = m.draw_id AND e.child = m.node_id
           AND e."left" <= m.position AND m.position < e."right" """,
    ),
    "tnode": (
        (),
        f"""SELECT c_custkey AS node_id, greatest(c_acctbal, 0.0::DOUBLE) AS time FROM customer
            UNION ALL SELECT o_orderkey + {PARENT_BASE}, 10000.0::DOUBLE + o_totalprice FROM orders""",
    ),
    "tiv": (
        ("tparent", "tnode"),
        """SELECT p.draw_id, p.position, a.time AS below, b.time AS above FROM tparent p
           JOIN tnode a USING (node_id) LEFT JOIN tnode b ON b.node_id = p.parent""",
    ),
}


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    found: list[str] = []
    for needed in CTES[name][0]:
        found += [n for n in _closure(needed) if n not in found]
    return (*found, name)


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named views, their inputs and any extra ones."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in _closure(name) if n not in wanted]
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in wanted]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
