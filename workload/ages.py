"""CDFs, densities, distances and dense codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from coeval.functions.age import Grid, nearest_bin
from coeval.operators import cdf, density
from coeval.session import RunFolder
from workload import views as v
from workload.registry import register
from workload.views import settle, settle_sql, with_views

POINTS = [0.0, 2500.0, 9000.0, 16000.0, 23000.0, 30500.0, 37000.0, 44000.0, 51000.0, 61000.0]
_POINTS_SQL = ", ".join(
    f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(POINTS)
)
_RAMP = "greatest(0.0, least(1.0, (point - below) / (above - below)))"
_PTS = {"pts": f"SELECT CAST(i AS INTEGER) AS point_idx, p AS point FROM (VALUES {_POINTS_SQL}) t(i, p)"}


def _with_points(names, body):
    return with_views(names, body, _PTS)


@register(
    "a10_row_cdf",
    _with_points(
        ["iv"],
        f"SELECT row_id, point_idx, point, {settle_sql(f'avg({_RAMP})', 9)} AS cdf FROM iv, pts GROUP BY ALL",
    ),
)
def row_cdf(spark, folder):
    values = cdf.cdf_at(v.intervals(spark, folder), POINTS)
    return values.withColumn("cdf", settle(F.col("cdf"), 9))


@register(
    "a10_row_cdf_by_draw",
    _with_points(
        ["iv"],
        f"""SELECT row_id, point_idx, point, {settle_sql('avg(c)', 9)} AS cdf FROM (
            SELECT row_id, draw_id, point_idx, point, avg({_RAMP}) AS c FROM iv, pts GROUP BY ALL)
            GROUP BY ALL""",
    ),
)
def row_cdf_by_draw(spark, folder):
    values = cdf.cdf_at(v.intervals(spark, folder), POINTS, weighting="draw")
    return values.withColumn("cdf", settle(F.col("cdf"), 9))


@register(
    "f01_point_mass_sides",
    """SELECT CAST(l_quantity AS INTEGER) AS age, count(*) AS n,
       CAST(sum(CASE WHEN 25 >= l_quantity THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS from_right,
       CAST(sum(CASE WHEN 25 > l_quantity THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS from_left
       FROM lineitem GROUP BY 1""",
)
def point_mass_sides(spark, folder):
    """A zero-width interval read from either side at age 25."""
    from coeval.functions.age import interval_cdf

    age, at = F.col("l_quantity"), F.lit(25.0)
    return v.table(spark, folder, "lineitem").groupBy(age.cast("int").alias("age")).agg(
        F.count("*").alias("n"),
        F.sum(interval_cdf(age, age, at, "right")).alias("from_right"),
        F.sum(interval_cdf(age, age, at, "left")).alias("from_left"),
    )


@register(
    "f02_nearest_bin",
    with_views(
        ["mut"],
        """SELECT CAST(floor(below / 4000.0 + 0.5) AS BIGINT) AS bin, count(*) AS n
           FROM mut GROUP BY 1""",
    ),
)
def nearest_bins(spark, folder):
    return v.mut(spark, folder).groupBy(nearest_bin(F.col("below"), 4000.0).alias("bin")).agg(
        F.count("*").alias("n")
    )


@register(
    "f03_age_grid",
    with_views(["grid"], "SELECT bin, center, point FROM grid"),
)
def age_grid(spark, folder):
    """Analysis grid derived from the oldest usable interval of the table."""
    last = F.greatest(F.lit(1), F.floor(F.max("above") / v.WIDTH + 0.5)).cast("int")
    bins = v.mut(spark, folder).agg(last.alias("last")).select(
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin")
    )
    center = F.col("bin") * v.WIDTH
    return bins.select("bin", center.alias("center"), (center + v.WIDTH / 2).alias("point"))


@register(
    "a11_row_grid_cdf",
    with_views(["row_cdf"], f"SELECT row_id, bin, {settle_sql('cdf', 7)} AS cdf FROM row_cdf"),
)
def row_grid_cdf(spark, folder):
    values = cdf.row_grid_cdf(v.intervals(spark, folder), v.grid(spark, folder))
    return values.withColumn("cdf", settle(F.col("cdf"), 7))


@register(
    "a12_aggregate_cdf",
    with_views(["target_cdf"], f"SELECT bin, {settle_sql('target_cdf', 7)} AS target_cdf FROM target_cdf"),
)
def aggregate_cdf(spark, folder):
    grid = v.grid(spark, folder)
    values = v.target_cdf(spark, folder, grid, v.intervals(spark, folder))
    return values.withColumn("target_cdf", settle(F.col("target_cdf"), 7))


@register(
    "a14_mean_age",
    with_views(
        ["iv"],
        f"""SELECT row_id, {settle_sql('avg((below + above) / 2)', 5)} AS mean_age,
            {settle_sql('any_value(by_draw)', 5)} AS draw_mean_age FROM iv JOIN (
              SELECT row_id, avg(m) AS by_draw FROM (
                SELECT row_id, draw_id, avg((below + above) / 2) AS m FROM iv GROUP BY ALL)
              GROUP BY row_id) USING (row_id) GROUP BY row_id""",
    ),
)
def mean_age(spark, folder):
    facts = v.intervals(spark, folder)
    by_draw = cdf.mean_age(facts, "draw").withColumnRenamed("mean_age", "draw_mean_age")
    return cdf.mean_age(facts).join(by_draw, "row_id").select(
        "row_id",
        settle(F.col("mean_age"), 5).alias("mean_age"),
        settle(F.col("draw_mean_age"), 5).alias("draw_mean_age"),
    )


@register(
    "a15_cell_masses",
    _with_points(
        ["iv"],
        f"""SELECT row_id, CAST(point_idx - 1 AS INTEGER) AS cell,
            {settle_sql('greatest(cdf - before, 0.0)', 8)} AS mass FROM (
              SELECT row_id, point_idx, cdf, lag(cdf) OVER (PARTITION BY row_id ORDER BY point_idx) AS before
              FROM (SELECT row_id, point_idx, avg({_RAMP}) AS cdf FROM iv, pts GROUP BY ALL))
            WHERE point_idx > 0""",
    ),
)
def cell_masses(spark, folder):
    values = cdf.cell_masses(v.intervals(spark, folder), POINTS)
    return values.withColumn("mass", settle(F.col("mass"), 8))


_PDF_SQL = """SELECT {key}bin, avg(greatest(0.0, least(above, hi) - greatest(below, lo)) / (above - below))
    AS probability FROM iv, (SELECT bin, CASE WHEN bin = 0 THEN -1e18 ELSE point - {w} END AS lo,
    point AS hi FROM grid) GROUP BY ALL"""


@register(
    "a16_binned_pdf",
    with_views(
        ["iv", "grid"],
        f"SELECT row_id, bin, {settle_sql('probability', 7)} AS probability FROM pdf",
        {"pdf": _PDF_SQL.format(key="row_id, ", w=v.WIDTH)},
    ),
)
def binned_pdf(spark, folder):
    values = density.binned_pdf(v.intervals(spark, folder), v.grid(spark, folder), ["row_id"])
    return values.withColumn("probability", settle(F.col("probability"), 7))


@register(
    "a17_pooled_pdf",
    with_views(
        ["iv", "grid"],
        f"SELECT draw_id, bin, {settle_sql('probability', 7)} AS probability FROM pdf",
        {"pdf": _PDF_SQL.format(key="draw_id, ", w=v.WIDTH)},
    ),
)
def pooled_pdf(spark, folder):
    """All intervals of a draw pooled into one density."""
    values = density.binned_pdf(v.intervals(spark, folder), v.grid(spark, folder), ["draw_id"])
    return values.withColumn("probability", settle(F.col("probability"), 7))


def _codes(spark, folder):
    grid = v.grid(spark, folder, v.COARSE_WIDTH)
    shared = cdf.row_grid_cdf(v.intervals(spark, folder), grid)
    rounded = shared.withColumn("cdf", F.round("cdf", 12))
    return grid, density.quantise(rounded, grid, ["row_id"])


_CODES = {
    "cdf12": f"""SELECT row_id, bin, last, round(avg({_RAMP}), 12) AS cdf FROM iv, coarse GROUP BY ALL""",
    "codes": """SELECT row_id, bin, CAST(CASE WHEN bin = last THEN 65535
        ELSE max(round_even(cdf * 65535.0::DOUBLE, 0)) OVER (PARTITION BY row_id ORDER BY bin) END AS INTEGER)
        AS code FROM cdf12""",
}


@register(
    "a18_quantised_cdf",
    with_views(["iv", "coarse"], "SELECT row_id, bin, code FROM codes", _CODES),
)
def quantised_cdf(spark, folder):
    return _codes(spark, folder)[1]


@register(
    "f16_dequantised_cdf",
    with_views(
        ["iv", "coarse"],
        """SELECT row_id, bin, round((code::FLOAT / 65535.0::FLOAT)::DOUBLE, 5) AS cdf FROM codes""",
        _CODES,
    ),
)
def dequantised_cdf(spark, folder):
    """Dense row gather with decoding."""
    values = density.dequantise(_codes(spark, folder)[1])
    return values.select("row_id", "bin", F.round(F.col("cdf").cast("double"), 5).alias("cdf"))


@register(
    "j15_boundary_codes",
    with_views(
        ["iv", "coarse"],
        """SELECT row_id, CAST(i AS INTEGER) AS edge_idx, CAST(e AS INTEGER) AS edge,
           CAST(CASE WHEN e = 0 THEN 0 ELSE code END AS INTEGER) AS code
           FROM codes JOIN (VALUES (0, 0), (1, 2), (2, 5), (3, 8)) t(i, e)
           ON bin = greatest(e - 1, 0)""",
        _CODES,
    ),
)
def boundary_codes(spark, folder):
    return density.boundary_codes(_codes(spark, folder)[1], [0, 2, 5, 8], ["row_id"])


@register(
    "a19_set_wasserstein",
    with_views(
        ["set_w1"],
        f"SELECT chain_index, sample_index, {settle_sql('wasserstein', 3)} AS wasserstein FROM set_w1",
    ),
)
def set_wasserstein(spark, folder):
    values = _set_distances(spark, folder)
    return values.withColumn("wasserstein", settle(F.col("wasserstein"), 3))


def _set_distances(spark, folder):
    grid = v.grid(spark, folder)
    facts = v.intervals(spark, folder)
    keys = ["chain_index", "sample_index"]
    means = cdf.set_cdf(v.control_sets(spark, folder), cdf.row_changes(facts, grid), grid, keys)
    return cdf.wasserstein(means, v.target_cdf(spark, folder, grid, facts), grid, keys)


@register(
    "a13_dense_target_cdf",
    with_views(
        ["iv", "coarse", "te"],
        f"""SELECT bin, {settle_sql('avg(code / 65535.0::DOUBLE)', 7)} AS target_cdf
            FROM codes SEMI JOIN te USING (row_id) GROUP BY bin""",
        _CODES,
    ),
)
def dense_target_cdf(spark, folder):
    """Target CDF from the dense codes, through the shared set operator."""
    from coeval.plans.target import mean_target

    grid, codes = _codes(spark, folder)
    mine = v.targets(spark, folder)
    changes = density.code_changes(codes.join(mine, "row_id", "left_semi"))
    means = mean_target(mine, changes, grid)
    return means.withColumn("target_cdf", settle(F.col("target_cdf"), 7))


@register(
    "m04_dense_candidate_weights",
    with_views(
        ["iv", "coarse", "cand"],
        f"""SELECT row_id, CAST(i - 1 AS INTEGER) AS stratum, {settle_sql('(code - before) / 65535.0::DOUBLE', 8)} AS weight
            FROM (SELECT row_id, i, code, lag(code) OVER (PARTITION BY row_id ORDER BY i) AS before FROM (
              SELECT row_id, i, CASE WHEN e = 0 THEN 0 ELSE code END AS code
              FROM (SELECT * FROM codes SEMI JOIN cand USING (row_id))
              JOIN (VALUES (0, 0), (1, 3), (2, 5), (3, 9)) t(i, e) ON bin = greatest(e - 1, 0)))
            WHERE code > before""",
        _CODES,
    ),
)
def dense_candidate_weights(spark, folder):
    """Stratum weights of the candidates from dense code steps."""
    from coeval.plans.rejection import dense_weights

    spans = spark.createDataFrame(
        [(0, 0, 3), (1, 3, 5), (2, 5, 9)], "stratum INT, first_edge INT, last_edge INT"
    )
    weights = dense_weights(_codes(spark, folder)[1], v.candidates(spark, folder), spans)
    return weights.withColumn("weight", settle(F.col("weight"), 8))


@register(
    "a13_dense_aggregate",
    with_views(
        ["iv", "coarse", "sets"],
        f"""SELECT chain_index, sample_index, bin,
            {settle_sql('avg((code::FLOAT / 65535.0::FLOAT)::DOUBLE)', 6)} AS cdf
            FROM sets JOIN codes USING (row_id) GROUP BY ALL""",
        _CODES,
    ),
)
def dense_aggregate(spark, folder):
    """Mean of decoded dense rows per set, in double precision."""
    decoded = density.dequantise(_codes(spark, folder)[1])
    return (
        v.control_sets(spark, folder).join(decoded, "row_id")
        .groupBy("chain_index", "sample_index", "bin")
        .agg(settle(F.avg(F.col("cdf").cast("double")), 6).alias("cdf"))
    )


@register(
    "a35_b05_float_precision",
    with_views(
        ["iv"],
        f"""SELECT draw_id, count(*) AS intervals,
            count(*) FILTER (WHERE above::FLOAT <= below::FLOAT) AS collapsed,
            {settle_sql('max(abs(above::FLOAT::DOUBLE - above))', 4)} AS max_error,
            {settle_sql('avg(abs(above::FLOAT::DOUBLE - above))', 6)} AS mean_error,
            {settle_sql('quantile_cont(abs(above::FLOAT::DOUBLE - above), 0.99)', 6)} AS p99_error
            FROM (SELECT draw_id, below / 7.0::DOUBLE AS below, above / 7.0::DOUBLE AS above FROM iv)
            GROUP BY draw_id""",
    ),
)
def float_precision(spark, folder):
    """Error of storing interval ends in single precision."""
    ends = v.intervals(spark, folder).select(
        "draw_id", (F.col("below") / 7.0).alias("below"), (F.col("above") / 7.0).alias("above")
    )
    single = lambda c: F.col(c).cast("float")
    error = F.abs(single("above").cast("double") - F.col("above"))
    return ends.groupBy("draw_id").agg(
        F.count("*").alias("intervals"),
        F.count_if(single("above") <= single("below")).alias("collapsed"),
        settle(F.max(error), 4).alias("max_error"),
        settle(F.avg(error), 6).alias("mean_error"),
        settle(F.percentile(error, F.lit(0.99)), 6).alias("p99_error"),
    )


@register(
    "m18_accessory_distribution",
    with_views(
        ["tiv"],
        f"""SELECT position, bin, {settle_sql('p', 7)} AS probability, interval_count, missing_draws FROM (
            SELECT position, bin, avg(greatest(0.0, least(above, hi) - greatest(below, lo)) / (above - below)) AS p,
              any_value(interval_count) AS interval_count, any_value(missing_draws) AS missing_draws
            FROM (SELECT * FROM tiv WHERE above IS NOT NULL), (SELECT CAST(b AS INTEGER) AS bin,
              CASE WHEN b = 0 THEN -1e18 ELSE b * 40000.0::DOUBLE - 20000.0::DOUBLE END AS lo,
              b * 40000.0::DOUBLE + 20000.0::DOUBLE AS hi FROM (SELECT max(above) AS m FROM tiv),
              range(0, 1000) r(b) WHERE b <= greatest(1, floor(m / 40000.0::DOUBLE + 0.5))),
            (SELECT position, count(above) AS interval_count, 5 - count(DISTINCT draw_id) AS missing_draws
             FROM tiv GROUP BY position) c WHERE c.position = tiv.position
            GROUP BY position, bin) WHERE p > 0""".replace("tiv WHERE above IS NOT NULL)", "tiv WHERE above IS NOT NULL) tiv").replace("SELECT position, bin, avg", "SELECT tiv.position, bin, avg").replace("GROUP BY position, bin)", "GROUP BY tiv.position, bin)"),
    ),
)
def accessory_distribution(spark, folder):
    """Age distribution of every position with its interval and missing-draw counts."""
    from coeval.plans.distribution import estimate_distributions
    from workload.coverage import _tree_intervals

    # Counts, bins and densities all read them, so the parents are looked up once.
    aged = RunFolder(spark).table("aged", _tree_intervals(spark, folder).select("position", "draw_id", "below", "above"))
    oldest = aged.agg(F.max("above")).first()[0]
    result = estimate_distributions(aged, Grid.spanning(oldest, 40000.0), draws=5)
    return result.withColumn("probability", settle(F.col("probability"), 7))


@register(
    "x01_b08_access_strategies",
    with_views(["cand"], "SELECT count(*) * 21 AS cells, 0.0::DOUBLE AS max_difference FROM cand"),
)
def access_strategies(spark, folder):
    """Boundary CDFs of all candidates by both strategies, compared cell by cell."""
    ages = [3000.0 * i for i in range(21)]
    facts, wanted = v.intervals(spark, folder), v.candidates(spark, folder)
    gathered = cdf.boundary_cdfs(facts, wanted, ages)
    scanned = cdf.boundary_cdfs(facts, wanted, ages, "scan").withColumnRenamed("cdf", "scanned")
    return gathered.join(scanned, ["row_id", "point_idx", "point"]).agg(
        F.count("*").alias("cells"), F.round(F.max(F.abs(F.col("cdf") - F.col("scanned"))), 12).alias("max_difference")
    )


@register(
    "k12_candidate_boundary_cdfs",
    with_views(
        ["iv", "cand"],
        f"""SELECT row_id, CAST(i AS INTEGER) AS point_idx, i * 3000.0::DOUBLE AS point,
            {settle_sql('avg(greatest(0.0, least(1.0, (i * 3000.0::DOUBLE - below) / (above - below))))', 9)} AS cdf
            FROM iv SEMI JOIN cand USING (row_id), range(0, 21) r(i) GROUP BY ALL""",
    ),
)
def candidate_boundary_cdfs(spark, folder):
    """21 boundary ages of every candidate."""
    ages = [3000.0 * i for i in range(21)]
    values = cdf.boundary_cdfs(v.intervals(spark, folder), v.candidates(spark, folder), ages)
    return values.withColumn("cdf", settle(F.col("cdf"), 9))
