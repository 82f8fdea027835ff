"""Site bootstrap of a target set, in counter mode and as a product of tiles.

Replicates are cut into blocks, targets and draws into spans. A block's draws
travel as packed arrays, a row for each span of targets they fall in, and meet
the span's changes in one task, which weighs and adds them replicate by
replicate. Rows that are shuffled number blocks times spans, whatever the number
of replicates, targets and changes.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators.ranks import dense_row_ids

TRACE_TILE = 1 << 16
#: Replicates of a block; targets of a span, which 16 bits of a packed draw number; draws made by a task at a time.
BLOCK, SPAN, DRAWN = 256, 1 << 16, 1 << 12


@dataclass(frozen=True)
class Draws:
    """``size`` draws with replacement for each replicate.

    Draw i of a replicate is a number from its counter, so equal in law to a
    multinomial and the same however blocks and spans are cut.
    """

    spark: SparkSession
    size: int
    replicates: int
    seed: int

    def __post_init__(self) -> None:
        if self.size <= 0 or self.replicates <= 0:
            raise ValueError("target size and replicates must be positive")

    @property
    def blocks(self) -> int:
        return -(-self.replicates // BLOCK)

    def packed(self) -> DataFrame:
        """(block, span, draws): draws as 32-bit numbers, the replicate's place in the block above the target's in the span."""
        pieces = -(-self.size // DRAWN)
        tasks = self.blocks * pieces
        slices = min(tasks, max(self.spark.sparkContext.defaultParallelism, tasks // 8))
        made = _packer(self.seed, self.size, self.replicates, pieces)
        return self.spark.range(0, tasks, 1, slices).mapInArrow(made, "block int, span int, draws binary")


def _packer(seed: int, size: int, replicates: int, pieces: int):
    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                block, piece = divmod(task, pieces)
                own = range(block * BLOCK, min(replicates, (block + 1) * BLOCK))
                at = range(piece * DRAWN, min(size, (piece + 1) * DRAWN))
                number = lambda r, i: int.from_bytes(hashlib.md5(f"{seed}|bootstrap|{r}|{i}".encode()).digest()[:6], "big")
                drawn = np.fromiter((number(r, i) for r in own for i in at), np.float64, len(own) * len(at))
                target = np.floor(drawn / 2.0**48 * size).astype(np.int64)
                place = np.repeat(np.arange(len(own), dtype=np.uint32), len(at))
                span = target // SPAN
                order = np.argsort(span, kind="stable")
                packed = (place << np.uint32(16) | (target % SPAN).astype(np.uint32))[order]
                spans, starts = np.unique(span[order], return_index=True)
                parts = np.split(packed, starts[1:])
                yield pa.record_batch({
                    "block": pa.array([block] * len(spans), pa.int32()),
                    "span": pa.array(spans, pa.int32()),
                    "draws": pa.array([x.tobytes() for x in parts], pa.binary()),
                })

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where each replicate's draws start, and all their targets' places, in order of the replicate's place in its block."""
    draws = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("draws")])
    draws = np.sort(draws)
    return np.searchsorted(draws, np.arange(BLOCK + 1, dtype=np.uint64) << np.uint64(16)), draws & np.uint32(SPAN - 1)


def _counter():
    """A block's draws in a span to (replicate, target_idx, times)."""

    def run(table: pa.Table) -> pa.Table:
        block, span = table.column("block")[0].as_py(), table.column("span")[0].as_py()
        draws = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("draws")])
        found, times = np.unique(draws, return_counts=True)
        replicate = (block * BLOCK + (found >> np.uint32(16)).astype(np.int64)).astype(np.int32)
        target = span * SPAN + (found & np.uint32(SPAN - 1)).astype(np.int64)
        return pa.table({"replicate": replicate, "target_idx": target, "times": times.astype(np.int64)})

    return run


def bootstrap_counts(draws: Draws) -> DataFrame:
    """(replicate, target_idx, times): how often each replicate draws each target."""
    return draws.packed().groupBy("block", "span").applyInArrow(_counter(), "replicate int, target_idx bigint, times bigint")


def _weigher(bins: int, replicates: int, finish):
    """Sums of changes, weighted by how often a replicate draws their target, as (replicate, slopes, levels), or what ``finish`` makes of them."""

    def run(drawn: pa.Table, packed: pa.Table) -> pa.Table:
        ids, sums = [], []
        if drawn.num_rows and packed.num_rows:
            join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in packed.column(name)])
            place, at, slope, level = join("places", np.int32), join("bins", np.int32), join("slopes", np.float64), join("levels", np.float64)
            starts, targets = _unpacked(drawn)
            block = drawn.column("block")[0].as_py()
            for k in range(min(BLOCK, replicates - block * BLOCK)):
                times = np.bincount(targets[starts[k] : starts[k + 1]], minlength=SPAN)[place]
                both = np.bincount(at, times * slope, bins), np.bincount(at, times * level, bins)
                ids.append(block * BLOCK + k)
                sums.append(finish(*both) if finish else both)
        return _rows(ids, sums, finish)

    return run


def _adder(bins: int, finish):
    """What ``finish`` makes of one replicate's sums over all spans."""

    def run(table: pa.Table) -> pa.Table:
        total = lambda name: table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, bins).sum(axis=0)
        return _rows([table.column("replicate")[0].as_py()], [finish(total("slopes"), total("levels"))], finish)

    return run


def _rows(ids: list[int], values: list, finish) -> pa.Table:
    kind = pa.list_(pa.float64())
    replicate = pa.array(ids, pa.int32())
    if finish is None:
        return pa.table({"replicate": replicate, "slopes": pa.array([v[0] for v in values], kind), "levels": pa.array([v[1] for v in values], kind)})
    return pa.table({"replicate": replicate, "value": pa.array(values, pa.float64() if finish.single else kind)})


class _Curve:
    """Mean CDF of summed changes."""

    single = False

    def __init__(self, bins: int, size: int) -> None:
        self.places, self.size = np.arange(bins), size

    def __call__(self, slopes: np.ndarray, levels: np.ndarray):
        return np.clip((self.places * np.cumsum(slopes) + np.cumsum(levels)) / self.size, 0.0, 1.0)


class _Distance(_Curve):
    """W1 of the mean CDF to another."""

    single = True

    def __init__(self, bins: int, size: int, width: float, goal: np.ndarray) -> None:
        super().__init__(bins, size)
        self.width, self.goal = width, goal

    def __call__(self, slopes: np.ndarray, levels: np.ndarray) -> float:
        return float(np.abs((super().__call__(slopes, levels) - self.goal)[:-1]).sum() * self.width)


def _packed_changes(target: DataFrame, changes: DataFrame) -> DataFrame:
    """(span, places, bins, slopes, levels): changes of pieces of a span as arrays of bytes."""
    rows = target.select("target_idx", "row_id").join(changes, "row_id")
    rows = rows.select((F.col("target_idx") / SPAN).cast("int").alias("span"), (F.col("target_idx") % SPAN).cast("int").alias("place"), F.col("bin").cast("int").alias("bin"), "slope", (F.col("intercept") + F.col("complete")).alias("level"))

    def pack(table: pa.Table) -> pa.Table:
        column = lambda name: pa.array([table.column(name).to_numpy().tobytes()], pa.binary())
        return pa.table({"span": table.column("span").slice(0, 1), "places": column("place"), "bins": column("bin"), "slopes": column("slope"), "levels": column("level")})

    return rows.groupBy("span", (F.col("place") / 2048).cast("int").alias("piece")).applyInArrow(pack, "span int, places binary, bins binary, slopes binary, levels binary")


def _replicates(draws: Draws, target: DataFrame, changes: DataFrame, grid: Grid, finish: _Curve) -> DataFrame:
    """(replicate, value): what ``finish`` makes of every replicate's summed changes.

    A task holds one block's draws in a span, and the changes of the span's
    targets. Where targets need several spans, their sums are added first.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(draws.blocks - 1))).alias("for_block")
    spread = _packed_changes(target, changes).withColumnRenamed("span", "for_span").select("*", blocks)
    met = draws.packed().groupBy("block", "span").cogroup(spread.groupBy("for_block", "for_span"))
    schema = f"replicate int, value {'double' if finish.single else 'array<double>'}"
    if draws.size <= SPAN:
        return met.applyInArrow(_weigher(grid.bins, draws.replicates, finish), schema)
    parts = met.applyInArrow(_weigher(grid.bins, draws.replicates, None), "replicate int, slopes array<double>, levels array<double>")
    return parts.groupBy("replicate").applyInArrow(_adder(grid.bins, finish), schema)


def replicate_cdfs(draws: Draws, target: DataFrame, changes: DataFrame, grid: Grid) -> DataFrame:
    """(replicate, bin, cdf): mean CDF of every replicate on the grid."""
    made = _replicates(draws, target, changes, grid, _Curve(grid.bins, draws.size))
    return made.select("replicate", F.posexplode("value").alias("bin", "cdf"))


def replicate_distances(draws: Draws, target: DataFrame, changes: DataFrame, observed: DataFrame, grid: Grid) -> DataFrame:
    """(replicate, wasserstein) to the observed target CDF (bin, target_cdf), of which the driver holds one number a bin."""
    goal = np.zeros(grid.bins)
    for r in observed.collect():
        goal[r["bin"]] = r["target_cdf"]
    made = _replicates(draws, target, changes, grid, _Distance(grid.bins, draws.size, grid.width, goal))
    return made.withColumnRenamed("value", "wasserstein")


def index_targets(rows: DataFrame) -> DataFrame:
    """Number target rows 0.. in ``row_id`` order.

    Uses the same tiled ranking as the catalog, so it holds at any target size.
    """
    ranked = dense_row_ids(rows.select(F.col("row_id").alias("position")))
    return ranked.select(F.col("row_id").alias("target_idx"), F.col("position").alias("row_id"))


def replicate_sizes(counts: DataFrame) -> DataFrame:
    """Draws per replicate: what the counts of every replicate must add up to."""
    return counts.groupBy("replicate").agg(F.sum("times").alias("draws"))


def best_restart(restarts: DataFrame) -> DataFrame:
    """Lowest distance per replicate; ties go to the first restart."""
    return restarts.groupBy("replicate").agg(
        F.min_by("restart", F.struct("wasserstein", "restart")).alias("restart"),
        F.min("wasserstein").alias("wasserstein"),
    )


def running_best(trace: DataFrame, keys: list[str], tile: int = TRACE_TILE) -> DataFrame:
    """Best-so-far distance and improvement per epoch of a trace.

    Epochs are cut into tiles: the running minimum starts from the best of the
    tiles before, so a trace of any length is spread over tasks.
    """
    cut = trace.withColumn("_tile", F.floor(F.col("epoch") / F.lit(tile)))
    earlier = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_tile")
        .agg(F.min("wasserstein").alias("_best"))
        .withColumn("_carry", F.min("_best").over(earlier))
        .drop("_best")
    )
    within = W.partitionBy(*keys, "_tile").orderBy("epoch")
    before = F.least(
        F.col("_carry"), F.min("wasserstein").over(within.rowsBetween(W.unboundedPreceding, -1))
    )
    return (
        cut.join(carried, [*keys, "_tile"])
        .withColumn("_before", before)
        .withColumn("best_distance", F.least("_before", "wasserstein"))
        .withColumn("improvement", F.coalesce(F.col("_before") - F.col("best_distance"), F.lit(0.0)))
        .drop("_tile", "_carry", "_before")
    )


# Workers get these functions whole, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
