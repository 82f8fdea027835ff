"""Stratified weighted rejection sampling of control sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.functions.rng import counter, uniform
from coeval.operators import cdf, density
from coeval.operators.ranks import smallest_by_key
from coeval.schema import CDF_SCALE
from coeval.session import RunFolder

#: What a stratum's weights add up to, in units; rows of a tile of cumulative weights.
WEIGHT_UNITS, INDEX_TILE = 1 << 44, 1 << 16
#: A stream's first length over its quota, and draws beyond; how often streams may be lengthened.
FIRST_DRAWS, SPARE_DRAWS, MOST_STEPS = 1.25, 16, 40


class SamplingError(RuntimeError):
    """The requested matched sets cannot be drawn."""


@dataclass
class MatchedSets:
    members: DataFrame
    proposals: DataFrame
    attempts: int
    rejected: int


def candidate_weights(intervals: DataFrame, candidates: DataFrame, strata: DataFrame) -> DataFrame:
    """(row_id, stratum, weight): positive candidate mass inside each stratum.

    There are at most twenty strata, so their ages are plan literals and the
    masses come from one wide aggregate per candidate.
    """
    spans = strata.select("stratum", "from_age", "to_age").orderBy("stratum").collect()
    edges = [s["from_age"] for s in spans] + [spans[-1]["to_age"]]
    own = intervals.join(candidates.select("row_id"), "row_id", "left_semi")
    return (
        cdf.cell_masses(own, edges)
        .where("mass > 0")
        .select("row_id", F.col("cell").alias("stratum"), F.col("mass").alias("weight"))
    )


def dense_weights(codes: DataFrame, candidates: DataFrame, strata: DataFrame) -> DataFrame:
    """The same weights from a dense store: code steps between stratum edges."""
    spans = strata.select("stratum", "first_edge", "last_edge").orderBy("stratum").collect()
    edges = [s["first_edge"] for s in spans] + [spans[-1]["last_edge"]]
    own = codes.join(candidates.select("row_id"), "row_id", "left_semi")
    before = F.lag("code").over(W.partitionBy("row_id").orderBy("edge_idx"))
    return (
        density.boundary_codes(own, edges, ["row_id"])
        .withColumn("_before", before)
        .where(F.col("code") > F.col("_before"))
        .select(
            "row_id",
            (F.col("edge_idx") - 1).alias("stratum"),
            ((F.col("code") - F.col("_before")) / F.lit(float(CDF_SCALE))).alias("weight"),
        )
    )


def weight_index(weights: DataFrame, run: RunFolder) -> tuple[DataFrame, DataFrame]:
    """Cumulative weights of every stratum, cut into cells that a number finds by equality.

    Weights become whole multiples of 2^-44 of their stratum's total, at least
    one, so sums are exact in any order. A row owns the numbers in [lo, hi); a
    cell lists the rows that own some of its numbers. A stratum has as many
    cells as rows, so cells hold two rows on average and rows and cells together
    bound what is listed, however uneven the weights are.

    Returns (stratum, cell, lo, hi, row_id) and (stratum, total, stock, width).
    """
    sums = weights.groupBy("stratum").agg(F.sum("weight").alias("_sum"))
    whole = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("_sum") * float(WEIGHT_UNITS))).cast("bigint")
    tile = F.floor(F.col("row_id") / F.lit(INDEX_TILE)).cast("bigint")
    # One row a stratum, of which there are at most twenty.
    units = weights.join(F.broadcast(sums), "stratum").select("stratum", "row_id", tile.alias("tile"), whole.alias("units"))
    units = run.table("weight-units", units)
    by_tile = units.groupBy("stratum", "tile").agg(F.sum("units").alias("_units"), F.count("*").alias("_rows"))
    before = W.partitionBy("stratum").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = run.table("weight-tiles", by_tile.withColumn("start", F.coalesce(F.sum("_units").over(before), F.lit(0))))
    total = F.sum("_units").alias("total")
    totals = tiles.groupBy("stratum").agg(total, F.sum("_rows").alias("stock"))
    totals = run.table("weight-totals", totals.withColumn("width", F.greatest(F.lit(1), F.expr("total div stock"))))
    inside = W.partitionBy("stratum", "tile").orderBy("row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = units.join(tiles.select("stratum", "tile", "start"), ["stratum", "tile"]).join(F.broadcast(totals), "stratum")
    placed = placed.withColumn("hi", F.col("start") + F.sum("units").over(inside)).withColumn("lo", F.col("hi") - F.col("units"))
    cells = F.explode(F.sequence(F.expr("lo div width"), F.expr("(hi - 1) div width"))).alias("cell")
    return run.table("weight-index", placed.select("stratum", cells, "lo", "hi", "row_id")), totals


def drawn_rows(asked: DataFrame, index: DataFrame, totals: DataFrame, seed: int) -> DataFrame:
    """Rows that the draws ``first`` .. ``last - 1`` of every (proposal_id, stratum) fall on.

    A draw is a number from its counter below the stratum's total, so each row
    comes with odds of its weight, draw by draw and with replacement. It is
    looked up by its cell. Adds ``at``, the draw's number, and ``row_id``.
    """
    at = F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("at")
    u = uniform(seed, "draw", F.col("proposal_id"), F.col("stratum"), F.col("at"))
    x = F.least(F.floor(u * F.col("total")), F.col("total") - 1).cast("bigint")
    draws = asked.where("last > first").join(F.broadcast(totals.select("stratum", "total", "width")), "stratum").select("*", at).withColumn("x", x)
    found = draws.withColumn("cell", F.expr("x div width")).join(index, ["stratum", "cell"]).where("lo <= x AND x < hi")
    return found.select(*asked.columns, "at", "row_id")


def _race(weights: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """Exponential race times per (proposal, stratum, row).

    Rows in order of ``-ln(u) / weight`` are a weighted draw without
    replacement, and so is that order restricted to any subset.
    """
    proposal = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("proposal_id")
    return _raced(weights.select("row_id", "stratum", "weight", proposal), seed).select("proposal_id", "stratum", "row_id", "race")


def _raced(rows: DataFrame, seed: int) -> DataFrame:
    u = (counter(seed, "race", F.col("proposal_id"), F.col("stratum"), F.col("row_id")) + 0.5) / float(16**12)
    return rows.withColumn("race", -F.log(u) / F.col("weight"))


def _resolver():
    """Fill a proposal's strata in their turns, each with the first rows of its stream that are still free."""

    def run(table: pa.Table) -> pa.Table:
        stratum, at, turn, rows, quota = (table.column(c).to_numpy() for c in ("stratum", "at", "turn", "row_id", "quota"))
        order = np.lexsort((at, stratum, turn))
        stratum, rows, quota = stratum[order], rows[order], quota[order]
        starts = np.flatnonzero(np.append(True, stratum[1:] != stratum[:-1]))
        taken = np.zeros(0, np.int64)
        made: list[tuple] = []
        for start, stop in zip(starts, np.append(starts[1:], len(rows))):
            mine = rows[start:stop]
            _, first = np.unique(mine, return_index=True)
            free = mine[np.sort(first)]
            picked = free[~np.isin(free, taken)][: quota[start]]
            taken = np.concatenate([taken, picked])
            made.append((int(stratum[start]), picked, int(quota[start]) - len(picked)))
        sizes = [len(p) for _, p, _ in made]
        short = [(s, n, len(p)) for s, p, n in made if n]
        proposal = table.column("proposal_id")[0].as_py()
        return pa.table({
            "proposal_id": pa.array([proposal] * (sum(sizes) + len(short)), pa.int32()),
            "stratum": pa.array(np.concatenate([np.repeat([s for s, _, _ in made], sizes), [s for s, _, _ in short]]).astype(np.int32)),
            "row_id": pa.array([*taken.tolist(), *[None] * len(short)], pa.int64()),
            "need": pa.array([0] * len(taken) + [n for _, n, _ in short], pa.int64()),
            "got": pa.array([0] * len(taken) + [n for _, _, n in short], pa.int64()),
        })

    return run


def draw_sets(
    weights: DataFrame, index: tuple[DataFrame, DataFrame], strata: DataFrame, first: int, last: int, seed: int, run: RunFolder
) -> tuple[DataFrame, DataFrame]:
    """Draw one set for each proposal id in [first, last].

    Strata are filled in a random order per proposal and a row taken by one
    stratum is gone for the next ones. A stratum's rows are those its stream of
    independent weighted draws falls on, repeats and taken rows left out: that
    is successive drawing without replacement. Streams start a little longer
    than their quotas, so a batch makes about as many rows as its sets have, and
    those that run out are drawn on. A stream that would become longer than its
    stratum has rows ends in a race over the stratum: from a given set of taken
    rows on, race order is successive drawing too.

    A task holds one proposal's streams, somewhat more rows than a set has.

    Returns (proposal_id, row_id, stratum) and (proposal_id, stratum, short).
    """
    quotas = strata.where("quota > 0").select("stratum", "quota")
    size = strata.agg(F.sum("quota")).first()[0]
    cells, totals = index
    # There are at most twenty strata.
    each = F.explode(F.array(*[F.struct(F.lit(r["stratum"]).alias("stratum"), F.lit(r["quota"]).cast("bigint").alias("quota")) for r in quotas.collect()]))
    proposals = run.spark.range(first, last + 1).select(F.col("id").cast("int").alias("proposal_id"), each.alias("s"))
    wanted = proposals.select("proposal_id", "s.*").withColumn("turn", uniform(seed, "turn", F.col("proposal_id"), F.col("stratum")))
    stocked = run.table(f"draw-{first}/wanted", wanted.join(F.broadcast(totals.select("stratum", "stock")), "stratum"))
    asked = stocked.withColumns({"first": F.lit(0).cast("bigint"), "last": F.ceil(F.col("quota") * FIRST_DRAWS).cast("bigint") + SPARE_DRAWS})
    columns = ["proposal_id", "stratum", "quota", "turn", "at", "row_id"]
    streams = run.table(f"draw-{first}/stream-0", drawn_rows(asked, cells, totals, seed).select(*columns))
    raced = None
    for step in range(1, MOST_STEPS):
        resolved = run.table(f"draw-{first}/resolved-{step}", streams.groupBy("proposal_id").applyInArrow(_resolver(), "proposal_id int, stratum int, row_id bigint, need bigint, got bigint"))
        short = resolved.where("row_id IS NULL").select("proposal_id", "stratum", "need", "got")
        if raced is not None:
            short = short.join(raced, ["proposal_id", "stratum"], "left_anti")
        short = run.table(f"draw-{first}/short-{step}", short)
        if short.isEmpty():
            break
        longer = F.col("last") + F.ceil(F.col("last") * F.col("need") / F.greatest("got", F.lit(1)) * FIRST_DRAWS).cast("bigint") + SPARE_DRAWS
        asked = run.table(
            f"draw-{first}/asked-{step}",
            asked.drop("first").join(short, ["proposal_id", "stratum"])
            .withColumn("_longer", longer)
            .select(*[c for c in asked.columns if c not in ("first", "last")], F.col("last").alias("first"), F.least("_longer", "stock").alias("last"), (F.col("_longer") >= F.col("stock")).alias("_race")),
        )
        racers = asked.where("_race").select("proposal_id", "stratum")
        raced = racers if raced is None else raced.unionAll(racers)
        own = _raced(weights.join(asked.where("_race"), "stratum"), seed)
        # At most ``size`` rows are taken before the race reaches its quota.
        fastest = smallest_by_key(own, ["proposal_id", "stratum"], "race", "row_id", F.lit(size), slot=F.floor(F.log("race") * 16))
        place = F.row_number().over(W.partitionBy("proposal_id", "stratum").orderBy("race", "row_id")) + F.lit(1 << 40)
        more = drawn_rows(asked.drop("_race"), cells, totals, seed).select(*columns)
        more = more.unionByName(fastest.withColumn("at", place.cast("bigint")).select(*columns))
        asked = asked.where(~F.col("_race")).drop("_race")
        streams = streams.unionByName(run.table(f"draw-{first}/stream-{step}", more))
    else:
        raise SamplingError("streams of draws did not end")
    taken = resolved.where("row_id IS NOT NULL").select("proposal_id", "row_id", "stratum")
    got = taken.groupBy("proposal_id", "stratum").agg(F.count("*").alias("got"))
    short = (
        wanted.drop("turn")
        .join(got, ["proposal_id", "stratum"], "left")
        .withColumn("short", F.col("quota") - F.coalesce("got", F.lit(0)))
        .where("short > 0")
        .select("proposal_id", "stratum", "short")
    )
    return taken, short


def generate_matches(
    weights: DataFrame,
    strata: DataFrame,
    changes: DataFrame,
    target_cdf: DataFrame,
    grid: Grid,
    threshold: float,
    accepted_sets: int,
    max_proposals: int,
    seed: int,
    run: RunFolder,
    batch: int = 64,
) -> MatchedSets:
    """Draw and score batches until enough proposals pass the exact W1 test.

    ``changes`` are the candidates' per-site changes on the exact grid.
    """
    if accepted_sets <= 0 or max_proposals <= 0 or batch <= 0:
        raise ValueError("accepted sets, proposals and batch must be positive")
    if not 0 <= threshold < float("inf"):
        raise ValueError("threshold must be finite and nonnegative")
    weights = run.table("weights", weights)
    index = weight_index(weights, run)
    kept: DataFrame | None = None
    log: DataFrame | None = None
    first, accepted = 1, 0
    while accepted < accepted_sets:
        if first > max_proposals:
            raise SamplingError(f"{accepted} of {accepted_sets} sets accepted after {max_proposals} proposals")
        last = min(first + batch - 1, max_proposals)
        drawn, short = draw_sets(weights, index, strata, first, last, seed, run)
        means = cdf.set_cdf(drawn, changes, grid, ["proposal_id"])
        scores = cdf.wasserstein(means, target_cdf, grid, ["proposal_id"])
        failed = short.groupBy("proposal_id").agg(F.min("stratum").alias("failed_stratum"))
        ids = run.spark.range(first, last + 1).select(F.col("id").cast("int").alias("proposal_id"))
        passed = F.col("failed_stratum").isNull() & (F.col("wasserstein") <= threshold)
        reason = (
            F.when(F.col("failed_stratum").isNotNull(), F.concat(F.lit("sampling: stratum "), F.col("failed_stratum")))
            .when(passed, F.lit("accepted"))
            .otherwise(F.lit("wasserstein_threshold"))
        )
        judged = run.table(
            f"draw-{first}/judged",
            ids.join(scores, "proposal_id", "left").join(failed, "proposal_id", "left").select(
                "proposal_id",
                F.when(F.col("failed_stratum").isNull(), F.col("wasserstein")).alias("wasserstein"),
                F.coalesce(passed, F.lit(False)).alias("accepted"),
                reason.alias("reason"),
            ),
        )
        winners = [
            r["proposal_id"]
            for r in judged.where("accepted").orderBy("proposal_id").limit(accepted_sets - accepted).collect()
        ]
        accepted += len(winners)
        if accepted == accepted_sets:
            judged = judged.where(F.col("proposal_id") <= winners[-1])
            last = winners[-1]
        log = judged if log is None else log.unionByName(judged)
        if winners:
            mine = drawn.where(F.col("proposal_id").isin(winners))
            kept = mine if kept is None else kept.unionByName(mine)
        first = last + 1
    return MatchedSets(kept, log, last, last - accepted)
