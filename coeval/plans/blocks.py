"""Swap rounds over many jobs at once.

A job is one chain, or one restart of one bootstrap replicate. Its state is a
table of (job, slot, row_id) with slots 0, 1, ... of the set.

Improving (``improve_round``). Every slot is offered one candidate, no candidate
twice. Slots are cut into random blocks of about ``block_slots``. Each block
measures its swaps against the job's whole residual r (current mean CDF minus
target), scaled to the block's own size: after the swaps of block b, its residual
is r + d_b with d_b the change of the block's own mean CDF. Blocks hold fractions
w_b of the slots, so the job's new residual is the w-weighted mean of the r + d_b,
and since W1 is a norm of the residual,

    W1(new) <= sum_b w_b * |r + d_b|.

Hence when every block only improves, the job improves, whatever order the blocks
ran in.

Walking (``walk_round``). A chain's proposals are independent draws of a slot and
a candidate, made in advance; one task replays them in order against the chain's
exact residual. A round is a stretch of the sequential walk, so neither its
length nor the number of tasks is part of the law. Chains run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.functions.rng import permutation_domain, permuted, uniform
from coeval.operators import cdf
from coeval.operators.ranks import dense_row_ids, ordinal_in_group, smallest_by_key
from coeval.plans import replay
from coeval.session import RunFolder

# Workers get the block runner itself, so executors need no installed package.
cloudpickle.register_pickle_by_value(replay)


#: Drawn rows that are broadcast to the tables they are looked up in; more are shuffled.
LOOKED_UP = 1_000_000
#: About so many accepted swaps are followed on the exact grid by one task.
PREFIX_SWAPS = 8192


def looked_up(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for drawn rows, of which there are at most ``rows``: the tables they meet stay where they are."""
    return F.broadcast(df) if rows <= LOOKED_UP else df


@dataclass(frozen=True)
class BlockConfig:
    block_slots: int = 1024
    walk_proposals: int = 65_536

    def validate(self) -> None:
        if self.block_slots <= 0 or self.walk_proposals <= 0:
            raise ValueError("block slots and proposals of a walk round must be positive")


def first_state(candidates: DataFrame, jobs: list[int], size: int, seed: int) -> DataFrame:
    """``size`` distinct random candidates per job, in slots 0, 1, ... by row."""
    job = F.explode(F.array(*[F.lit(j) for j in jobs])).alias("job")
    keyed = candidates.select("row_id", job).withColumn(
        "key", uniform(seed, "first", F.col("job"), F.col("row_id"))
    )
    chosen = smallest_by_key(keyed, ["job"], "key", "row_id", F.lit(size))
    return numbered(chosen)


def numbered(members: DataFrame) -> DataFrame:
    """(job, slot, row_id): the rows of every job in slots 0, 1, ... by row."""
    return ordinal_in_group(members.select("job", "row_id"), ["job"], ["row_id"], "row_id").select("job", F.col("ord").alias("slot"), "row_id")


def indexed(candidates: DataFrame) -> DataFrame:
    """(idx, row_id) with idx 0, 1, ... over all candidates."""
    return dense_row_ids(candidates.select(F.col("row_id").alias("position"))).select(F.col("row_id").alias("idx"), F.col("position").alias("row_id"))


def job_cdfs(state: DataFrame, changes: DataFrame, grid: Grid) -> DataFrame:
    """Mean CDF per job, from the rows it holds."""
    return cdf.set_cdf(state.select("job", "row_id"), changes, grid, ["job"])


def residual_arrays(cdfs: DataFrame, targets: DataFrame) -> DataFrame:
    """(job, residual): one grid-sized array per job. ``targets`` has (job, bin, target_cdf)."""
    cells = cdfs.join(targets, ["job", "bin"]).groupBy("job").agg(
        F.array_sort(F.collect_list(F.struct("bin", (F.col("cdf") - F.col("target_cdf")).alias("r")))).alias("c")
    )
    return cells.select("job", F.transform("c", lambda x: x["r"]).alias("residual"))


def _offers(state: DataFrame, pool: DataFrame, pool_size: int, jobs: list[int], size: int, seed: int, tag: str) -> DataFrame:
    """(job, slot, row_id): another candidate for every slot, none twice in a job.

    Turn after turn a permutation of the candidates' numbers is read; numbers
    beyond the pool and rows that the job holds are passed over, and the next
    one goes to the next slot of a permutation of the job's slots. Work follows
    the set's size, not the pool's. A few turns more than expected are read; past
    that, or with fewer candidates than slots, slots go without, others each round.
    """
    outside = max(0, pool_size - size)
    domain = permutation_domain(pool_size)
    turns = min(domain, math.ceil(1.1 * size * domain / max(1, outside)) + 256)
    job = F.explode(F.array(*[F.lit(j) for j in jobs])).alias("job")
    drawn = state.sparkSession.range(turns).select(F.col("id").alias("turn"), job).withColumn("idx", permuted(F.col("turn"), domain, seed, tag, F.col("job")))
    rows = drawn.where(F.col("idx") < pool_size).join(pool, "idx").join(state.select("job", "row_id"), ["job", "row_id"], "left_anti")
    ranked = ordinal_in_group(rows, ["job"], ["turn"], "turn")
    mixed = state.select("job", "slot", permuted(F.col("slot"), permutation_domain(size), seed, tag, "slots", F.col("job")).alias("place"))
    slots = ordinal_in_group(mixed, ["job"], ["place"], "place").select("job", "ord", "slot")
    return ranked.where(F.col("ord") < size).join(slots, ["job", "ord"]).select("job", "slot", "row_id")


def improve_round(
    state: DataFrame,
    pool: DataFrame,
    pool_size: int,
    profiles: DataFrame,
    residuals: DataFrame,
    grid: Grid,
    jobs: list[int],
    size: int,
    seed: int,
    tag: str,
    config: BlockConfig,
    absolute: float = 0.0,
    relative: float = 0.0,
) -> DataFrame:
    """Swaps and tallies of one improving round. ``pool`` is ``indexed`` candidates."""
    blocks = max(1, math.ceil(size / config.block_slots))
    draw = lambda name: uniform(seed, tag, name, F.col("job"), F.col("slot"))
    mine = state.where(F.col("job").isin(jobs))
    both = mine.withColumn("kind", F.lit(replay.SLOT)).unionByName(
        _offers(mine, pool, pool_size, jobs, size, seed, tag).withColumn("kind", F.lit(replay.OFFER))
    )
    # A slot and its offer are in one block and have one turn.
    placed = both.withColumns({"block": F.floor(draw("block") * blocks).cast("int"), "ord": draw("turn")})
    paired = placed.join(
        placed.where(F.col("kind") == replay.OFFER).select("job", "slot"), ["job", "slot"], "left_semi"
    )
    spread = residuals.select(
        F.col("job").alias("goal_job"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("goal_block"), "residual"
    )
    return (
        paired.join(profiles, "row_id")
        .groupBy("job", "block")
        .cogroup(spread.groupBy("goal_job", "goal_block"))
        .applyInPandas(replay.block_runner(grid.width, absolute, relative), schema=replay.OUTPUT)
    )


def walk_round(
    state: DataFrame,
    pool: DataFrame,
    pool_size: int,
    profiles: DataFrame,
    goals: DataFrame,
    grid: Grid,
    jobs: list[int],
    size: int,
    seed: int,
    tag: str,
    proposals: int,
) -> DataFrame:
    """Swaps and tallies of one stretch of every job's walk.

    ``goals`` has (job, residual, limit, required). A proposal is drawn by its
    number alone; its slot and its candidate are looked up by equal keys. A
    round's proposals are few beside the tables, so they travel to them: a round
    shuffles what it drew and reads, but never moves, the pool, sets and profiles.
    """
    job = F.explode(F.array(*[F.lit(j) for j in jobs])).alias("job")
    draw = lambda name, n: F.least(F.floor(uniform(seed, tag, name, F.col("job"), F.col("ord")) * n), F.lit(n - 1)).cast("bigint")
    drawn = state.sparkSession.range(proposals).select(F.col("id").alias("ord"), job)
    drawn = drawn.withColumns({"slot": draw("slot", size), "idx": draw("candidate", pool_size)})
    most = proposals * len(jobs)
    placed = looked_up(drawn, most).join(pool, "idx")
    mine = state.where(F.col("job").isin(jobs))
    held = mine.join(looked_up(placed.select("job", "row_id"), most), ["job", "row_id"], "left_semi").withColumn("held", F.lit(True))
    offers = placed.join(looked_up(held.select("job", "row_id", "held"), most), ["job", "row_id"], "left").select(
        "job", F.lit(replay.OFFER).alias("kind"), F.col("ord").cast("double").alias("ord"), "slot", "row_id", F.coalesce("held", F.lit(False)).alias("inside")
    )
    slots = mine.join(looked_up(drawn.select("job", "slot"), most), ["job", "slot"], "left_semi").select(
        "job", F.lit(replay.SLOT).alias("kind"), F.lit(0.0).alias("ord"), "slot", "row_id", F.lit(True).alias("inside")
    )
    spread = goals.select(F.col("job").alias("goal_job"), "residual", "limit", "required", F.lit(size).alias("size"))
    return (
        looked_up(slots.unionByName(offers), 2 * most).join(profiles, "row_id")
        .groupBy("job")
        .cogroup(spread.groupBy("goal_job"))
        .applyInPandas(replay.walk_runner(grid.width), schema=replay.OUTPUT)
    )


def shortest_prefix(
    swaps: DataFrame, count: int, profiles: DataFrame, goals: DataFrame, grid: Grid, size: int, config: BlockConfig, run: RunFolder, tag: str
) -> DataFrame:
    """Of each job's accepted swaps in turn, those up to the first that brings it within its limit.

    ``goals`` has (job, residual, limit) on the exact grid, before the round;
    ``count`` is the number of swaps. Turns are cut into stretches, each followed
    by a task of its own from the residual that all earlier ones leave, so a
    task's share does not grow with the set.
    """
    turns = max(1, PREFIX_SWAPS // max(1, math.ceil(size / config.block_slots)))
    both = swaps.where("slot >= 0").select(
        "job", F.floor(F.col("turn") / turns).cast("int").alias("part"), "block", "slot", "turn",
        F.explode(F.array(F.struct(F.lit(replay.SLOT).alias("kind"), F.col("old_id").alias("row_id")), F.struct(F.lit(replay.OFFER).alias("kind"), "row_id"))).alias("x"),
    )
    moved = run.table(f"{tag}/moved", looked_up(both.select("job", "part", "block", "slot", "turn", "x.*"), 2 * count).join(profiles, "row_id"))
    sign = F.when(F.col("kind") == replay.OFFER, 1.0).otherwise(-1.0) / size
    names = ("slope", "intercept", "complete")
    steps = moved.select("job", "part", sign.alias("sign"), F.explode(F.arrays_zip("bins", "slopes", "intercepts", "completes")).alias("c"))
    summed = steps.groupBy("job", "part", F.col("c.bins").alias("bin")).agg(*[F.sum(F.col(f"c.{n}s") * F.col("sign")).alias(n) for n in names])
    earlier = W.partitionBy("job", "bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = cdf.lines(summed, grid, ["job", "part"]).withColumn("before", F.coalesce(F.sum("value").over(earlier), F.lit(0.0)))
    gaps = before.groupBy("job", "part").agg(F.array_sort(F.collect_list(F.struct("bin", "before"))).alias("b"))
    spread = gaps.join(goals.select("job", "residual", "limit"), "job").select(
        F.col("job").alias("goal_job"), F.col("part").alias("goal_part"),
        F.zip_with("residual", F.col("b.before"), lambda r, b: r + b).alias("residual"), "limit", F.lit(size).alias("size"),
    )
    followed = run.table(
        f"{tag}/followed",
        moved.groupBy("job", "part").cogroup(spread.groupBy("goal_job", "goal_part"))
        .applyInPandas(replay.prefix_runner(grid.width), schema=replay.OUTPUT),
    )
    ends = followed.where("slot < 0 AND tried > 0").groupBy("job").agg(F.min("block").alias("end"))
    # A row a job.
    return followed.join(F.broadcast(ends), "job", "left").where("end IS NULL OR block <= end").drop("end")


def tallies(swaps: DataFrame) -> dict[int, tuple[int, int, int]]:
    """(accepted, tried, redrawn) per job: one driver row per job."""
    counts = [F.sum(c).alias(c) for c in ("accepted", "tried", "redrawn")]
    return {r["job"]: (r["accepted"], r["tried"], r["redrawn"]) for r in swaps.where("slot < 0").groupBy("job").agg(*counts).collect()}


def job_distances(cdfs: DataFrame, targets: DataFrame, grid: Grid) -> DataFrame:
    """W1 of each job's CDF to its own target."""
    return cdf.wasserstein(cdfs, targets, grid, ["job"])


def for_every_job(target_cdf: DataFrame, jobs: list[int]) -> DataFrame:
    """One shared target listed under each job."""
    return target_cdf.select(
        F.explode(F.array(*[F.lit(j) for j in jobs])).alias("job"), "bin", "target_cdf"
    )
