"""Genotype counts, projections and spectrum distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from coeval.functions.genotype import decode_genotype, info_value
from coeval.operators import spectrum
from coeval.sources import text_inputs, vcf
from workload import views as v
from workload.registry import register
from workload.views import settle, settle_sql, with_views

SAMPLES = 40
KEYS = ["chain_index", "sample_index"]


@register(
    "a23_genotype_counts",
    with_views(["counts"], "SELECT row_id, k, n FROM counts"),
)
def genotype_counts(spark, folder):
    return v.site_counts(spark, folder)


@register("p08_callable_sites", with_views(["counts"], "SELECT row_id, k, n FROM counts WHERE n >= 20"))
def callable_sites(spark, folder):
    return spectrum.callable_sites(v.site_counts(spark, folder))


_LOG_CHOOSE = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
_PROJECTION = {
    "pairs": "SELECT DISTINCT k, n FROM counts WHERE n >= 20",
    "proj": f"""SELECT k, n, CAST(j AS INTEGER) AS bin,
        CASE WHEN j > k OR 20 - j > n - k THEN 0.0::DOUBLE ELSE exp(
          {_LOG_CHOOSE.format(a='k', b='j')} + {_LOG_CHOOSE.format(a='(n - k)', b='(20 - j)')}
          - {_LOG_CHOOSE.format(a='n', b='20')}) END AS mass FROM pairs, range(0, 21) r(j)""",
    "members": """SELECT -1 AS chain_index, -1 AS sample_index, row_id FROM te
                  UNION ALL SELECT chain_index, sample_index, row_id FROM sets""",
    "spectra": """SELECT chain_index, sample_index, bin, sum(mass) AS raw
                  FROM members JOIN counts USING (row_id) JOIN proj USING (k, n) GROUP BY ALL""",
    "normal": """SELECT *, raw / sum(raw) OVER (PARTITION BY chain_index, sample_index) AS normalised
                 FROM spectra WHERE bin BETWEEN 1 AND 19""",
    "residuals": """SELECT s.chain_index, s.sample_index, s.bin, s.raw, s.normalised,
                    t.normalised AS target_normalised, t.normalised - s.normalised AS residual
                    FROM normal s JOIN normal t ON t.bin = s.bin AND t.chain_index = -1
                    WHERE s.chain_index >= 0""",
}


def _with_projection(body):
    return with_views(["counts", "te", "sets"], body, _PROJECTION)


@register(
    "f04_f05_projections",
    _with_projection(f"SELECT k, n, bin, {settle_sql('mass', 8)} AS mass FROM proj"),
)
def projections(spark, folder):
    long = spectrum.project_long(v.site_counts(spark, folder))
    return long.withColumn("mass", settle(F.col("mass"), 8))


def _members(spark, folder):
    target = v.targets(spark, folder).select(
        F.lit(-1).alias("chain_index"), F.lit(-1).alias("sample_index"), "row_id"
    )
    return target.unionByName(v.control_sets(spark, folder))


def _spectra(spark, folder):
    return spectrum.accumulate_spectra(
        _members(spark, folder), v.site_counts(spark, folder), KEYS, ["row_id"]
    )


@register(
    "a24_spectra",
    _with_projection(
        f"SELECT chain_index, sample_index, bin, {settle_sql('raw', 6)} AS raw FROM spectra"
    ),
)
def spectra(spark, folder):
    return _spectra(spark, folder)[0].withColumn("raw", settle(F.col("raw"), 6))


@register(
    "a25_normalised_spectra",
    _with_projection(
        f"""SELECT chain_index, sample_index, bin, {settle_sql('raw', 6)} AS raw,
            {settle_sql('normalised', 8)} AS normalised FROM normal"""
    ),
)
def normalised_spectra(spark, folder):
    normal = spectrum.normalise(_spectra(spark, folder)[0], KEYS)
    return normal.withColumns(
        {"raw": settle(F.col("raw"), 6), "normalised": settle(F.col("normalised"), 8)}
    )


@register(
    "a32_retained_diagnostics",
    _with_projection(
        f"""SELECT chain_index, sample_index, input_sites, eligible_sites,
            input_sites - eligible_sites AS dropped,
            {settle_sql('retained', 6)} AS retained_mass, {settle_sql('endpoint', 6)} AS endpoint_mass,
            {settle_sql('retained / eligible_sites', 8)} AS retained_fraction,
            {settle_sql('endpoint / eligible_sites', 8)} AS endpoint_fraction FROM (
              SELECT chain_index, sample_index, count(*) AS input_sites,
              count(*) FILTER (WHERE n >= 20) AS eligible_sites
              FROM members LEFT JOIN counts USING (row_id) GROUP BY ALL)
            JOIN (SELECT chain_index, sample_index, sum(raw) FILTER (WHERE bin BETWEEN 1 AND 19) AS retained,
              sum(raw) FILTER (WHERE bin IN (0, 20)) AS endpoint FROM spectra GROUP BY ALL)
            USING (chain_index, sample_index)"""
    ),
)
def retained_diagnostics(spark, folder):
    masses, counted = _spectra(spark, folder)
    result = spectrum.retained_diagnostics(masses, counted, KEYS)
    return result.withColumns(
        {
            "retained_mass": settle(F.col("retained_mass"), 6),
            "endpoint_mass": settle(F.col("endpoint_mass"), 6),
            "retained_fraction": settle(F.col("retained_fraction"), 8),
            "endpoint_fraction": settle(F.col("endpoint_fraction"), 8),
        }
    )


def _phi_bins(spark, folder):
    normal = spectrum.normalise(_spectra(spark, folder)[0], KEYS)
    target = normal.where("chain_index < 0").select(
        "bin", F.col("normalised").alias("target_normalised")
    )
    return spectrum.phi_bins(target, normal.where("chain_index >= 0"), KEYS)


@register(
    "k07_phi_bins",
    _with_projection(
        f"""SELECT chain_index, sample_index, bin, {settle_sql('raw', 6)} AS raw,
            {settle_sql('normalised', 8)} AS normalised,
            {settle_sql('target_normalised', 8)} AS target_normalised,
            {settle_sql('residual', 8)} AS residual,
            {settle_sql('greatest(residual, 0.0)', 8)} AS positive FROM residuals"""
    ),
)
def phi_bins(spark, folder):
    bins = _phi_bins(spark, folder)
    digits = {"raw": 6, "normalised": 8, "target_normalised": 8, "residual": 8, "positive": 8}
    return bins.withColumns({c: settle(F.col(c), d) for c, d in digits.items()})


@register(
    "q3_phi_sfs",
    _with_projection(
        f"""SELECT chain_index, sample_index,
            {settle_sql('sum(greatest(residual, 0.0))', 7)} AS phi_sfs,
            {settle_sql('sum(greatest(-residual, 0.0))', 7)} AS reverse_positive,
            {settle_sql('sum(abs(residual)) / 2', 7)} AS half_l1,
            {settle_sql('1.0 - sum(greatest(residual, 0.0))', 7)} AS overlap
            FROM residuals GROUP BY ALL"""
    ),
)
def phi_sfs(spark, folder):
    """Distance of every control spectrum to the target spectrum."""
    scores = spectrum.phi_scores(_phi_bins(spark, folder), KEYS).drop("identity_max_abs_error")
    return scores.withColumns(
        {c: settle(F.col(c), 7) for c in ("phi_sfs", "reverse_positive", "half_l1", "overlap")}
    )


# --- VCF text -----------------------------------------------------------------


def genotype_cells(spark, folder):
    """(row_id, sample, gt): 40 samples, the suppliers folded onto them.

    An uncalled item makes the sample missing; mixed line states make it
    heterozygous.
    """
    line = v.table(spark, folder, "lineitem")
    derived = F.col("l_linestatus") == "F"
    cells = line.groupBy(
        F.col("l_partkey").alias("row_id"), (F.col("l_suppkey") % SAMPLES).cast("int").alias("sample")
    ).agg(
        F.bool_or(F.col("l_tax") == 0).alias("gap"),
        F.bool_or(derived).alias("some"),
        F.bool_and(derived).alias("every"),
    )
    gt = (
        F.when(F.col("gap"), F.lit("./."))
        .when(F.col("every"), F.lit("1|1"))
        .when(F.col("some"), F.lit("0/1"))
        .otherwise(F.lit("0/0"))
    )
    return cells.select("row_id", "sample", gt.alias("gt"))


def vcf_lines(spark, folder):
    """One VCF record per part; at most 40 sample columns each."""
    cells = genotype_cells(spark, folder).groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("calls")
    )
    columns = F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLES - 1)),
        lambda s: F.concat(F.lit("9:"), F.coalesce(F.try_element_at("calls", s), F.lit("."))),
    )
    ancestral = F.when(F.col("row_id") % 3 == 0, F.lit("G")).otherwise(F.lit("A"))
    record = F.concat_ws(
        "\t",
        F.lit("chr1"), (F.col("row_id") + 1).cast("string"), F.lit("."), F.lit("A"), F.lit("G"),
        F.lit("."), F.lit("PASS"), F.concat(F.lit("DP=9;AA=T;AA="), ancestral), F.lit("DP:GT"),
        F.array_join(columns, "\t"),
    )
    return cells.select(record.alias("value"))


_CELLS = """SELECT l_partkey AS row_id, l_suppkey % 40 AS sample,
    CASE WHEN bool_or(l_tax = 0) THEN './.' WHEN bool_and(l_linestatus = 'F') THEN '1|1'
         WHEN bool_or(l_linestatus = 'F') THEN '0/1' ELSE '0/0' END AS gt
    FROM lineitem GROUP BY ALL"""


@register(
    "s10_vcf_site_counts",
    f"""SELECT 'chr1' AS chrom, row_id + 1 AS pos,
        CASE WHEN row_id % 3 = 0 THEN n - alt ELSE alt END AS k, n, CAST(NULL AS VARCHAR) AS problem
        FROM (SELECT row_id, count(*) FILTER (WHERE gt IN ('1|1', '0/0')) AS n,
              count(*) FILTER (WHERE gt = '1|1') AS alt FROM ({_CELLS}) GROUP BY row_id)
        WHERE row_id IN (SELECT p_partkey FROM part WHERE p_size <= 25)""",
)
def vcf_site_counts(spark, folder):
    """Parse text records of the requested parts, polarised by INFO."""
    requested = v.table(spark, folder, "part").where("p_size <= 25").select(
        F.lit("chr1").alias("chrom"), (F.col("p_partkey") + 1).alias("pos")
    )
    return vcf.site_counts(
        vcf_lines(spark, folder), requested, ancestral="info", heterozygous="missing"
    )


@register(
    "p09_vcf_record_problems",
    f"""SELECT problem, count(*) AS records FROM (
          SELECT row_id, CASE WHEN bool_or(gt = '0/1') THEN 'heterozygous genotype' END AS problem
          FROM ({_CELLS}) GROUP BY row_id) GROUP BY problem""",
)
def vcf_record_problems(spark, folder):
    """All records under the strict heterozygous rule, polarised by REF."""
    requested = v.table(spark, folder, "part").select(
        F.lit("chr1").alias("chrom"), (F.col("p_partkey") + 1).alias("pos")
    )
    counts = vcf.site_counts(vcf_lines(spark, folder), requested)
    return counts.groupBy("problem").agg(F.count("*").alias("records"))


@register(
    "j10_vcf_completeness",
    """SELECT 'chr1' AS chrom, p AS pos, 'absent' AS problem FROM (
         SELECT o_custkey + 1 AS p FROM orders UNION SELECT -1 - s_suppkey FROM supplier)
       WHERE p - 1 NOT IN (SELECT l_partkey FROM lineitem)""",
)
def vcf_completeness(spark, folder):
    """Requested coordinates with no record: customers past the parts, and suppliers."""
    asked = v.table(spark, folder, "orders").select((F.col("o_custkey") + 1).alias("pos")).unionByName(
        v.table(spark, folder, "supplier").select((-1 - F.col("s_suppkey")).alias("pos"))
    ).select(F.lit("chr1").alias("chrom"), "pos")
    counts = vcf.site_counts(vcf_lines(spark, folder), asked, heterozygous="missing")
    return vcf.completeness_problems(asked, counts)


@register(
    "f06_decoded_genotypes",
    f"""SELECT gt, CAST(CASE gt WHEN '1|1' THEN 1 WHEN '0/0' THEN 0 WHEN '0/1' THEN -3 END AS INTEGER)
        AS allele, count(*) AS calls FROM ({_CELLS}) GROUP BY ALL""",
)
def decoded_genotypes(spark, folder):
    cells = genotype_cells(spark, folder)
    return cells.groupBy("gt", decode_genotype(F.col("gt")).alias("allele")).agg(
        F.count("*").alias("calls")
    )


@register(
    "f07_info_values",
    """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1""",
)
def info_values(spark, folder):
    """Last value of a repeated INFO key over every event."""
    info = F.concat(
        F.lit("FLAG;U=x;T="), F.col("event_type"), F.lit(";U="), F.col("user_id").cast("string"), F.lit(";V=1=2")
    )
    return v.table(spark, folder, "events").groupBy(info_value(info, "U").alias("value")).agg(
        F.count("*").alias("n")
    )


@register(
    "s07_native_position_list",
    """SELECT chrom, native, problem, count(*) AS n FROM (
         SELECT 'chr' || c_nationkey AS chrom,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_custkey END AS native,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN 'position is not an integer'
                WHEN c_custkey < 1 THEN 'position below 1' END AS problem
         FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY ALL""",
)
def native_position_list(spark, folder):
    """Position list text with comments, stray blanks and bad lines."""
    segment = F.col("c_mktsegment")
    value = F.when(segment == "BUILDING", F.lit("  # building")).otherwise(
        F.concat(
            F.lit(" chr"), F.col("c_nationkey"), F.lit("\t "),
            F.when(segment == "MACHINERY", F.lit("n/a")).otherwise(F.col("c_custkey").cast("string")),
            F.lit("  # "), segment,
        )
    )
    lines = v.table(spark, folder, "customer").select(value.alias("value"))
    return text_inputs.native_positions(lines).groupBy("chrom", "native", "problem").agg(
        F.count("*").alias("n")
    )


@register(
    "s08_numeric_positions",
    "SELECT CAST(ps AS DOUBLE) AS position FROM (SELECT p_partkey + 0.5 AS ps FROM part)",
)
def numeric_positions(spark, folder):
    lines = v.table(spark, folder, "part").select(
        F.concat((F.col("p_partkey") + 0.5).cast("string"), F.lit("\t"), F.col("p_name"), F.lit(" # x")).alias("value")
    )
    return text_inputs.numeric_positions(lines)
