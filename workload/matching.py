"""Targets, strata, bootstrap, samplers and their certification."""

from __future__ import annotations

from pyspark.sql import functions as F

from coeval.operators import bootstrap, cdf, diversity, strata
from coeval.operators.ranks import empirical_quantile, smallest_by_key
from coeval.plans import blocks, matcher, rejection, swap, validation
from coeval.plans.target import TargetConfig, build_target, mean_target
from coeval.session import RunFolder
from workload import views as v
from workload.registry import register
from workload.views import _uniform_sql, settle, settle_sql, with_views

REPLICATES = 20
QUANTILE = 0.5
SETS = ["chain_index", "sample_index"]


# --- Bootstrap ------------------------------------------------------------------

def _boot_views(replicates: int) -> dict[str, str]:
    return {
        "tidx": "SELECT row_number() OVER (ORDER BY row_id) - 1 AS target_idx, row_id FROM te",
        "boot": f"""SELECT CAST(r AS INTEGER) AS replicate,
            CAST(floor({_uniform_sql(f"'{v.SEED}'", "'bootstrap'", "r::VARCHAR", "target_idx::VARCHAR")}
            * (SELECT count(*) FROM te)) AS BIGINT) AS target_idx, count(*) AS times
            FROM tidx, range(0, {replicates}) x(r) GROUP BY ALL""",
        "rep_cdf": """SELECT replicate, bin, sum(cdf * times) / sum(times) AS cdf
            FROM boot JOIN tidx USING (target_idx) JOIN row_cdf USING (row_id) GROUP BY ALL""",
        "rep_w1": f"""SELECT replicate, sum(abs(cdf - target_cdf) * {v.WIDTH!r}::DOUBLE) AS wasserstein
            FROM rep_cdf JOIN target_cdf USING (bin) JOIN grid USING (bin) WHERE bin < last GROUP BY ALL""",
    }


_BOOT = _boot_views(REPLICATES)


def _with_boot(body, extra=None, views=()):
    return with_views(["te", "row_cdf", "target_cdf", *views], body, {**_BOOT, **(extra or {})})


def _target_parts(spark, folder):
    """(grid, target rows, their number, their changes on the grid)."""
    grid = v.grid(spark, folder)
    mine = v.targets(spark, folder)
    own = v.intervals(spark, folder).join(mine, "row_id", "left_semi")
    return grid, mine, mine.count(), cdf.row_changes(own, grid)


@register("a21_bootstrap_counts", _with_boot("SELECT replicate, target_idx, times FROM boot"))
def bootstrap_counts(spark, folder):
    size = v.targets(spark, folder).count()
    return bootstrap.bootstrap_counts(bootstrap.Draws(spark, size, REPLICATES, v.SEED))


@register(
    "a21_bootstrap_cdfs",
    _with_boot(f"SELECT replicate, bin, {settle_sql('cdf', 7)} AS cdf FROM rep_cdf"),
)
def bootstrap_cdfs(spark, folder):
    grid, mine, size, changes = _target_parts(spark, folder)
    rows = bootstrap.index_targets(mine)
    draws = bootstrap.Draws(spark, size, REPLICATES, v.SEED)
    means = bootstrap.replicate_cdfs(draws, rows, changes, grid)
    return means.withColumn("cdf", settle(F.col("cdf"), 7))


def _distances(spark, folder):
    grid, mine, size, changes = _target_parts(spark, folder)
    rows = bootstrap.index_targets(mine)
    draws = bootstrap.Draws(spark, size, REPLICATES, v.SEED)
    return bootstrap.replicate_distances(draws, rows, changes, mean_target(mine, changes, grid), grid)


@register(
    "a20_bootstrap_distances",
    _with_boot(f"SELECT replicate, {settle_sql('wasserstein', 3)} AS wasserstein FROM rep_w1"),
)
def bootstrap_distances(spark, folder):
    return _distances(spark, folder).withColumn("wasserstein", settle(F.col("wasserstein"), 3))


@register(
    "a22_acceptance_threshold",
    _with_boot(
        f"""SELECT {settle_sql('wasserstein', 3)} AS threshold FROM rep_w1
            ORDER BY wasserstein LIMIT 1 OFFSET CAST(ceil({(REPLICATES - 1) * QUANTILE}) AS BIGINT)"""
    ),
)
def acceptance_threshold(spark, folder):
    found = empirical_quantile(_distances(spark, folder), "wasserstein", QUANTILE)
    return found.withColumn("threshold", settle(F.col("threshold"), 3))


# --- Strata and quotas ------------------------------------------------------------

_STRATA = {
    "scaled": """SELECT bin, target_cdf / (SELECT max_by(target_cdf, bin) FROM target_cdf) AS edge_cdf
                 FROM target_cdf""",
    "edges": f"""SELECT 0::BIGINT AS edge, 0.0::DOUBLE AS edge_cdf UNION
        SELECT (SELECT max(bin) + 1 FROM scaled), max_by(edge_cdf, bin) FROM scaled UNION
        SELECT b.bin + 1, b.edge_cdf FROM scaled b JOIN (SELECT min(bin) AS bin
          FROM scaled, range(1, 20) r(i) WHERE edge_cdf >= i * 0.05::DOUBLE GROUP BY i) m USING (bin)""",
    "spans": f"""SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS stratum,
        CAST(edge AS INTEGER) AS first_edge, CAST(lead(edge) OVER (ORDER BY edge) AS INTEGER) AS last_edge,
        (edge - 0.5) * {v.WIDTH!r}::DOUBLE AS from_age,
        (lead(edge) OVER (ORDER BY edge) - 0.5) * {v.WIDTH!r}::DOUBLE AS to_age,
        lead(edge_cdf) OVER (ORDER BY edge) - edge_cdf AS raw FROM edges""",
    "shares": "SELECT *, raw / sum(raw) OVER () AS share FROM spans WHERE last_edge IS NOT NULL",
    "quotas": """SELECT *, CAST(fl + CASE WHEN row_number() OVER (ORDER BY ideal - fl DESC, stratum)
          <= x - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (
          SELECT *, share * x AS ideal, CAST(floor(share * x) AS BIGINT) AS fl FROM shares,
          (SELECT count(*) AS x FROM te))""",
}


def _strata(spark, folder):
    grid, mine, size, changes = _target_parts(spark, folder)
    edges = strata.equal_mass_edges(mean_target(mine, changes, grid), grid)
    return strata.largest_remainder(strata.strata(edges), size)


@register(
    "m02_m03_strata_quotas",
    with_views(
        ["target_cdf", "te"],
        f"""SELECT stratum, first_edge, last_edge, from_age, to_age,
            {settle_sql('share', 8)} AS share, quota FROM quotas""",
        _STRATA,
    ),
)
def strata_quotas(spark, folder):
    return _strata(spark, folder).withColumn("share", settle(F.col("share"), 8))


_WEIGHTS = {
    **_STRATA,
    "bounds": """SELECT row_number() OVER (ORDER BY age) - 1 AS b, age FROM (
        SELECT from_age AS age FROM shares UNION SELECT to_age FROM shares)""",
    "at_bounds": """SELECT row_id, b, avg(greatest(0.0, least(1.0, (age - below) / (above - below)))) AS c
        FROM iv SEMI JOIN cand USING (row_id), bounds GROUP BY ALL""",
    "weights": """SELECT row_id, CAST(b - 1 AS INTEGER) AS stratum, c - p AS weight FROM (
        SELECT *, lag(c) OVER (PARTITION BY row_id ORDER BY b) AS p FROM at_bounds) WHERE c > p""",
}


@register(
    "m04_candidate_weights",
    with_views(
        ["target_cdf", "te", "iv", "cand"],
        f"SELECT row_id, stratum, {settle_sql('weight', 8)} AS weight FROM weights WHERE weight > 0",
        _WEIGHTS,
    ),
)
def candidate_weights(spark, folder):
    weights = rejection.candidate_weights(
        v.intervals(spark, folder), v.candidates(spark, folder), _strata(spark, folder)
    )
    return weights.where("weight > 0").withColumn("weight", settle(F.col("weight"), 8))


@register(
    "m05_weighted_race",
    with_views(
        ["target_cdf", "te", "iv", "cand"],
        f"""SELECT proposal_id, stratum, row_id FROM (
            SELECT *, row_number() OVER (PARTITION BY proposal_id, stratum ORDER BY race, row_id) AS rk FROM (
              SELECT CAST(p AS INTEGER) AS proposal_id, stratum, row_id, quota,
              -ln((('0x' || substr(md5('{v.SEED}' || '|race|' || p || '|' || stratum || '|' || row_id), 1, 12))::BIGINT
                + 0.5::DOUBLE) / {float(16**12)!r}::DOUBLE) / weight AS race
              FROM weights JOIN quotas USING (stratum), range(1, 4) r(p) WHERE weight > 0))
            WHERE rk <= quota""",
        _WEIGHTS,
    ),
)
def weighted_race(spark, folder):
    """First draw of every stratum: the quota's fastest candidates in three proposals."""
    spans = _strata(spark, folder)
    weights = rejection.candidate_weights(
        v.intervals(spark, folder), v.candidates(spark, folder), spans
    ).where("weight > 0")
    raced = rejection._race(weights, 1, 3, v.SEED).join(spans.select("stratum", "quota"), "stratum")
    chosen = smallest_by_key(
        raced, ["proposal_id", "stratum"], "race", "row_id", F.col("quota"),
        slot=F.floor(F.log("race") * 16),
    )
    return chosen.select("proposal_id", "stratum", "row_id")


#: Longest possible list of strata, which fill in turn.
MOST_STRATA = 20


def _draw_views(proposals: int) -> dict[str, str]:
    """Views down to ``drawn`` (proposal_id, stratum, row_id): streams of weighted draws, strata filled in their turns.

    Streams here are four quotas long and more, which must not run out; where a
    stratum has too few rows for that, the rows of ``drawn`` show it.
    """
    number = lambda *parts: _uniform_sql(f"'{v.SEED}'", *parts)
    views = {
        **_WEIGHTS,
        "units": f"""SELECT stratum, row_id, greatest(1, CAST(round(weight / sum(weight) OVER (PARTITION BY stratum)
            * {float(rejection.WEIGHT_UNITS)!r}::DOUBLE) AS BIGINT)) AS units FROM weights WHERE weight > 0""",
        "ends": "SELECT stratum, row_id, CAST(sum(units) OVER (PARTITION BY stratum ORDER BY row_id) AS BIGINT) AS hi FROM units",
        "turns": f"""SELECT CAST(p AS INTEGER) AS proposal_id, stratum, quota,
            row_number() OVER (PARTITION BY p ORDER BY {number("'turn'", "p::VARCHAR", "stratum::VARCHAR")}) AS turn
            FROM quotas, range(1, {proposals + 1}) r(p) WHERE quota > 0""",
        "draws": f"""SELECT t.*, least(CAST(floor({number("'draw'", "proposal_id::VARCHAR", "stratum::VARCHAR", "n::VARCHAR")} * total) AS BIGINT), total - 1) AS x
            FROM (SELECT *, unnest(range(0, 4 * quota + 64)) AS n FROM turns) t
            JOIN (SELECT stratum, max(hi) AS total FROM ends GROUP BY 1) USING (stratum)""",
        "firsts": """SELECT d.proposal_id, d.stratum, d.quota, d.turn, e.row_id, min(n) AS n
            FROM draws d ASOF JOIN ends e ON d.stratum = e.stratum AND d.x < e.hi GROUP BY ALL""",
        "drawn_0": "SELECT proposal_id, stratum, row_id FROM firsts WHERE false",
    }
    for k in range(1, MOST_STRATA + 1):
        views[f"drawn_{k}"] = f"""SELECT * FROM drawn_{k - 1} UNION ALL SELECT proposal_id, stratum, row_id FROM (
            SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY n) AS rk FROM firsts f WHERE turn = {k}
            AND NOT EXISTS (SELECT 1 FROM drawn_{k - 1} g WHERE g.proposal_id = f.proposal_id AND g.row_id = f.row_id)) WHERE rk <= quota"""
    return views


@register(
    "m05_stratified_draws",
    with_views(
        ["target_cdf", "te", "iv", "cand"],
        f"SELECT proposal_id, stratum, row_id FROM drawn_{MOST_STRATA}",
        _draw_views(3),
    ),
)
def stratified_draws(spark, folder):
    """Three proposals: every stratum in its turn filled by weighted draws without replacement."""
    run, spans = RunFolder(spark), _strata(spark, folder)
    weights = run.table("weights", rejection.candidate_weights(v.intervals(spark, folder), v.candidates(spark, folder), spans))
    drawn, _ = rejection.draw_sets(weights, rejection.weight_index(weights, run), spans, 1, 3, v.SEED, run)
    return drawn.select("proposal_id", "stratum", "row_id")


# --- Sets: reuse, diversity, scores -----------------------------------------------


@register(
    "a27_reuse_counts",
    with_views(["sets"], "SELECT row_id, count(*) AS uses FROM sets GROUP BY row_id"),
)
def reuse_counts(spark, folder):
    return diversity.reuse_counts(v.control_sets(spark, folder))


_ADJACENT = """SELECT a.chain_index, a.sample_index, 1.0 - count(b.row_id)::DOUBLE / count(*) AS replacement
    FROM sets a LEFT JOIN sets b ON b.chain_index = a.chain_index
    AND b.sample_index = a.sample_index - 1 AND b.row_id = a.row_id
    WHERE a.sample_index > 0 GROUP BY ALL"""


@register(
    "w06_adjacent_replacement",
    with_views(
        ["sets"],
        f"SELECT chain_index, sample_index, {settle_sql('replacement', 8)} AS replacement FROM ({_ADJACENT})",
    ),
)
def adjacent_replacement(spark, folder):
    values = diversity.adjacent_replacement(v.control_sets(spark, folder))
    return values.withColumn("replacement", settle(F.col("replacement"), 8))


@register(
    "a28_w07_chain_diversity",
    with_views(
        ["set_w1"],
        f"""SELECT chain_index, sets, {settle_sql('mean_r', 8)} AS mean_replacement,
            {settle_sql('min_r', 8)} AS minimum_replacement, {settle_sql('lag1', 6)} AS lag1_autocorrelation,
            {settle_sql('sets * mean_r / (2.0 - mean_r)', 6)} AS membership_ess FROM (
              SELECT chain_index, avg(replacement) AS mean_r, min(replacement) AS min_r
              FROM adjacent GROUP BY chain_index) JOIN (
              SELECT chain_index, count(*) AS sets, corr(wasserstein, before) AS lag1 FROM (
                SELECT *, lag(wasserstein) OVER (PARTITION BY chain_index ORDER BY sample_index) AS before
                FROM set_w1) GROUP BY chain_index) USING (chain_index)""",
        {"adjacent": _ADJACENT},
    ),
)
def chain_diversity(spark, folder):
    from workload.ages import _set_distances

    values = diversity.chain_diversity(v.control_sets(spark, folder), _set_distances(spark, folder))
    digits = {"mean_replacement": 8, "minimum_replacement": 8, "lag1_autocorrelation": 6, "membership_ess": 6}
    return values.withColumns({c: settle(F.col(c), d) for c, d in digits.items()})


@register(
    "t04_best_restart",
    with_views(
        ["set_w1"],
        f"""SELECT chain_index AS replicate, arg_min(sample_index, wasserstein) AS restart,
            {settle_sql('min(wasserstein)', 3)} AS wasserstein FROM set_w1 GROUP BY chain_index""",
    ),
)
def best_restart(spark, folder):
    from workload.ages import _set_distances

    named = _set_distances(spark, folder).withColumnsRenamed(
        {"chain_index": "replicate", "sample_index": "restart"}
    )
    return bootstrap.best_restart(named).withColumn("wasserstein", settle(F.col("wasserstein"), 3))


@register(
    "t03_closest_seeds",
    _with_boot(
        """SELECT replicate, CAST(place - 1 AS INTEGER) AS restart, set_id, 'closest' AS kind FROM placed WHERE place <= 2
           UNION ALL SELECT replicate, CAST(1 + turn AS INTEGER), set_id, 'diverse' FROM (
             SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY u, set_id) AS turn FROM placed WHERE place > 2) WHERE turn <= 1""",
        {"placed": f"""SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY d, set_id) AS place,
             {_uniform_sql(f"'{v.SEED}'", "'diverse'", "replicate::VARCHAR", "set_id::VARCHAR")} AS u
             FROM (SELECT replicate, CAST(s.chain_index * 3 + s.sample_index AS INTEGER) AS set_id,
                   sum(abs(s.cdf - r.cdf)) AS d FROM set_cdf s JOIN rep_cdf r USING (bin)
                   JOIN grid USING (bin) WHERE bin < last GROUP BY ALL)"""},
        views=("set_cdf",),
    ),
)
def closest_seeds(spark, folder):
    """The two control sets nearest to each bootstrap replicate, and another by lot."""
    grid, mine, size, changes = _target_parts(spark, folder)
    rows = bootstrap.index_targets(mine)
    draws = bootstrap.Draws(spark, size, REPLICATES, v.SEED)
    means = bootstrap.replicate_cdfs(draws, rows, changes, grid)
    every = cdf.row_changes(v.intervals(spark, folder), grid)
    seeds = v.control_sets(spark, folder).select(
        (F.col("chain_index") * 3 + F.col("sample_index")).alias("set_id"), "row_id"
    )
    return matcher.choose_seeds(cdf.set_cdf(seeds, every, grid, ["set_id"]), means, grid, 2, 1, v.SEED)


@register(
    "w08_best_so_far",
    f"""SELECT user_id, event_id AS epoch, best AS best_distance,
        {settle_sql("coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY event_id) - best, 0.0)", 6)} AS improvement
        FROM (SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best
              FROM events)""",
)
def best_so_far(spark, folder):
    """Best value so far in every user's event sequence, as a search trace."""
    trace = v.table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("epoch"), F.col("value").alias("wasserstein")
    )
    return bootstrap.running_best(trace, ["user_id"]).select(
        "user_id", "epoch", "best_distance", settle(F.col("improvement"), 6).alias("improvement")
    )


@register(
    "m08_first_state",
    with_views(
        ["cand", "te"],
        f"""SELECT job, row_id FROM (SELECT job, row_id, row_number() OVER (PARTITION BY job ORDER BY u, row_id) AS rk
            FROM (SELECT CAST(j AS INTEGER) AS job, row_id,
                  {_uniform_sql(f"'{v.SEED}'", "'first'", "j::VARCHAR", "row_id::VARCHAR")} AS u
                  FROM cand, range(0, 3) r(j))) WHERE rk <= (SELECT count(*) FROM te)""",
    ),
)
def first_state(spark, folder):
    """Random start of three chains: as many candidates as there are targets."""
    size = v.targets(spark, folder).count()
    state = blocks.first_state(v.candidates(spark, folder), [0, 1, 2], size, v.SEED)
    return state.select("job", "row_id")


@register(
    "p13_f17_quality_flags",
    """SELECT o_orderkey AS id, CASE WHEN e > 0 THEN m / e ELSE 'Infinity'::DOUBLE END AS error_ratio,
       (CASE WHEN e > 0 THEN m / e ELSE 'Infinity'::DOUBLE END) < 0.5 AND m <= 500 AS qc_pass
       FROM (SELECT o_orderkey, (o_custkey % 5)::DOUBLE AS e, floor(o_totalprice / 1000.0)::DOUBLE AS m FROM orders)""",
)
def quality_flags(spark, folder):
    """Matching error over bootstrap distance, zero distances included."""
    price = F.col("o_totalprice") / 1000.0
    # floor() makes a bigint: NaN would become 0 and pass, and what is beyond 2^53 is whole already.
    whole = F.when(F.abs(price) < float(2**53), F.floor(price).cast("double")).otherwise(price)
    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 5).cast("double").alias("bootstrap_distance"),
        whole.alias("match_bootstrap"),
    )
    flagged = matcher.with_quality(rows, matcher.OptimizerConfig())
    return flagged.select("id", "error_ratio", "qc_pass")


@register(
    "p14_triangle_check",
    """SELECT l_returnflag AS flag, count(*) AS broken FROM lineitem
       WHERE NOT (l_tax + 1e-8 >= abs(l_discount - 0.05) AND l_tax <= l_discount + 0.05 + 1e-8) GROUP BY 1""",
)
def triangle_check(spark, folder):
    """Triples that break the triangle inequality, over every line item."""
    rows = v.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_discount").alias("bootstrap_distance"),
        F.lit(0.05).alias("match_bootstrap"),
        F.col("l_tax").alias("match_observed"),
    )
    return validation.triangle_problems(rows).groupBy("flag").agg(F.count("*").alias("broken"))


# --- Whole samplers, certified --------------------------------------------------


def _prepared(spark, folder, replicates=60, quantile=0.9):
    run = RunFolder(spark)
    facts, sites = v.intervals(spark, folder), v.sites(spark, folder)
    mine, pool = v.targets(spark, folder), v.candidates(spark, folder)
    oldest = facts.agg(F.max("above")).first()[0]
    config = TargetConfig(v.WIDTH, replicates, quantile, v.SEED)
    target = build_target(facts, mine, oldest, config, run)
    return run, facts, sites, mine, pool, oldest, target


def _certified(members, keys, sites, mine, pool, facts, target):
    """(keys, size, problems, within): rules and exact distance recomputed from members."""
    problems = validation.bad_members(members, sites, mine, keys, target.size, pool)
    counted = problems.groupBy(*keys).agg(F.count("*").alias("found"))
    changes = cdf.row_changes(
        facts.join(members.select("row_id").distinct(), "row_id", "left_semi"), target.grid
    )
    means = cdf.set_cdf(members, changes, target.grid, keys)
    scores = cdf.wasserstein(means, target.cdf, target.grid, keys)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size"))
    return sizes.join(counted, keys, "left").join(scores, keys).select(
        *keys, "size", F.coalesce("found", F.lit(0)).cast("bigint").alias("problems"), "wasserstein"
    )


#: Of a prepared target: bootstrap replicates and the quantile of their distances that is allowed.
ALLOWED_REPLICATES, ALLOWED_QUANTILE = 60, 0.9
#: Proposals that may be drawn.
MOST_PROPOSALS = 64

_REJECTION = {
    **_boot_views(ALLOWED_REPLICATES),
    "allowed": f"""SELECT wasserstein AS threshold FROM rep_w1 ORDER BY wasserstein
        LIMIT 1 OFFSET CAST(ceil({(ALLOWED_REPLICATES - 1) * ALLOWED_QUANTILE!r}) AS BIGINT)""",
    **_draw_views(MOST_PROPOSALS),
    "own_cdf": f"SELECT proposal_id, bin, avg(cdf) AS cdf, count(*) AS size FROM drawn_{MOST_STRATA} JOIN row_cdf USING (row_id) GROUP BY ALL",
    "own_w1": f"""SELECT proposal_id, size, sum(abs(cdf - target_cdf) * {v.WIDTH!r}::DOUBLE) AS wasserstein
        FROM own_cdf JOIN target_cdf USING (bin) JOIN grid USING (bin) WHERE bin < last GROUP BY ALL""",
}


@register(
    "m07_rejection_sampler",
    with_views(
        ["target_cdf", "te", "iv", "cand"],
        f"""SELECT CAST(row_number() OVER (ORDER BY proposal_id) - 1 AS INTEGER) AS set_index, proposal_id, size, 0::BIGINT AS problems,
            {settle_sql("wasserstein", 3)} AS wasserstein, {settle_sql("threshold", 3)} AS threshold
            FROM own_w1, allowed WHERE wasserstein <= threshold AND size = (SELECT count(*) FROM te)
            ORDER BY proposal_id LIMIT 2""",
        _REJECTION,
    ),
)
def rejection_sampler(spark, folder):
    """The first two proposals of the stratified sampler that pass, certified from their members."""
    run, facts, sites, mine, pool, oldest, target = _prepared(spark, folder, ALLOWED_REPLICATES, ALLOWED_QUANTILE)
    weights = rejection.candidate_weights(facts, pool, target.strata)
    changes = run.table("pool-changes", cdf.row_changes(facts.join(pool, "row_id", "left_semi"), target.grid))
    result = rejection.generate_matches(
        weights, target.strata, changes, target.cdf, target.grid, target.threshold,
        accepted_sets=2, max_proposals=MOST_PROPOSALS, seed=v.SEED, run=run, batch=16,
    )
    checked = _certified(result.members, ["proposal_id"], sites, mine, pool, facts, target)
    order = F.row_number().over(validation.W.orderBy("proposal_id")) - 1
    return checked.select(
        order.alias("set_index"), "proposal_id", "size", "problems", settle(F.col("wasserstein"), 3).alias("wasserstein"),
        settle(F.lit(target.threshold), 3).alias("threshold"),
    )


@register(
    "q2_m08_m10_swap_chains",
    with_views(
        ["te"],
        """SELECT CAST(c AS INTEGER) AS chain_index, CAST(s AS INTEGER) AS sample_index,
           (SELECT count(*) FROM te) AS size, 0::BIGINT AS problems, true AS within, true AS certified
           FROM range(0, 2) a(c), range(0, 2) b(s)""",
    ),
)
def swap_chains(spark, folder):
    """Two chains of two saved sets; every rule and claim recomputed from members."""
    run, facts, sites, mine, pool, oldest, target = _prepared(spark, folder)
    config = swap.SwapConfig(chains=2, sets_per_chain=2, construction=swap.Construction(bin_width=8000))
    chains = swap.run_chains(facts, pool, target, oldest, v.SEED, config, run)
    checked = _certified(chains.members, SETS, sites, mine, pool, facts, target)
    claimed = chains.sets.withColumnRenamed("wasserstein", "claimed")
    return checked.join(claimed, SETS).select(
        *SETS, "size", "problems",
        (F.col("wasserstein") <= target.threshold + 1e-6).alias("within"),
        (F.abs(F.col("wasserstein") - F.col("claimed")) <= 1e-6).alias("certified"),
    )


@register(
    "m13_m15_bootstrap_matcher",
    with_views(
        ["te"],
        """SELECT CAST(r AS INTEGER) AS replicate, (SELECT count(*) FROM te) AS size,
           0::BIGINT AS problems, true AS improved FROM range(0, 3) a(r)""",
    ),
)
def bootstrap_matcher(spark, folder):
    """Three bootstrap replicates matched from random seed sets, certified."""
    run, facts, sites, mine, pool, oldest, target = _prepared(spark, folder, replicates=20)
    seeds = run.table(
        "seed-sets",
        blocks.first_state(pool, [0, 1, 2, 3], target.size, v.SEED).select(
            F.col("job").alias("set_id"), "row_id"
        ),
    )
    config = matcher.OptimizerConfig(
        replicates=3, bin_width=2000.0, seeds=matcher.Seeds(closest=1, diverse=1),
        stopping=matcher.Stopping(least=2, most=4, patience=1),
    )
    found = matcher.match_replicates(facts, pool, target, seeds, oldest, v.SEED, config, run)
    checked = _certified(found.members, ["replicate"], sites, mine, pool, facts, target)
    better = found.replicates.select("replicate", (F.col("match_bootstrap") <= F.col("initial")).alias("improved"))
    return checked.join(better, "replicate").select("replicate", "size", "problems", "improved")


@register(
    "v01_store_validation",
    """SELECT * FROM (VALUES ('bad counters', 0::BIGINT), ('bad coverage', 0::BIGINT),
         ('bad intervals', 0::BIGINT), ('bad order', 0::BIGINT), ('bad row ids', 0::BIGINT),
         ('bad status', 0::BIGINT)) t("check", violations)
       UNION ALL SELECT 'intervals', count(*) FROM lineitem WHERE l_returnflag <> 'R'""",
)
def store_validation(spark, folder):
    """Every store check over the whole derived store, with the interval count."""
    from coeval.operators import catalog

    sites = v.sites(spark, folder)
    facts = v.intervals(spark, folder)
    status = (
        catalog.draw_status(catalog.per_draw_coverage(v.mut(spark, folder)))
        .join(sites.select("position", "row_id"), "position")
        .select("draw_id", "row_id", "status")
    )
    checks = {
        "bad counters": validation.bad_counters(sites, v.DRAWS),
        "bad coverage": validation.bad_coverage(sites, facts),
        "bad intervals": validation.bad_intervals(facts),
        "bad order": validation.bad_position_order(sites),
        "bad row ids": validation.bad_row_ids(sites),
        "bad status": validation.bad_status(status, facts),
        "intervals": facts,
    }
    result = None
    for name, rows in checks.items():
        counted = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        result = counted if result is None else result.unionByName(counted)
    return result


@register(
    "v03_dense_validation",
    """SELECT count(DISTINCT l_partkey) AS rows, 0::BIGINT AS violations FROM lineitem WHERE l_returnflag <> 'R'""",
)
def dense_validation(spark, folder):
    from coeval.schema import CDF_SCALE
    from workload.ages import _codes

    grid, codes = _codes(spark, folder)
    bad = validation.bad_codes(codes, grid.bins, CDF_SCALE).agg(F.count("*").alias("violations"))
    return codes.agg(F.count_distinct("row_id").alias("rows")).select(
        "rows", F.lit(bad.first()["violations"]).cast("bigint").alias("violations")
    )
