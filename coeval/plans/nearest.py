"""Nearest seed sets of every bootstrap replicate, measured in tiles behind a bound.

Sets and replicates are dealt to tiles, and a task holds one tile of each. A
difference of CDFs summed over a stretch of bins cannot exceed its summed
absolute values, so sums over a few stretches bound W1 from below. Per replicate,
sets are measured in order of that bound until it exceeds the distance of the
last one kept; the nearest of all tiles are among the nearest of each.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sets or replicates of a tile; stretches that a CDF is summed over for the bound.
TILE, STRETCHES = 64, 64

SCHEMA = "replicate int, set_id int, wasserstein double, u double, measured bigint"


def _searcher(width: float, closest: int, others: int, seed: int):
    """Of a tile of replicates and one of sets: each replicate's nearest sets, and the first by lot."""

    def arrays(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column(name).to_numpy()
        curves = table.column("curve").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :-1]
        order = np.argsort(ids)
        return ids[order], curves[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        if left.num_rows and right.num_rows:
            replicates, goals = arrays(left, "replicate")
            sets, curves = arrays(right, "set_id")
            cuts = np.unique(np.linspace(0, curves.shape[1], min(STRETCHES, max(1, curves.shape[1])) + 1).astype(int)[:-1]) if curves.shape[1] else np.zeros(0, int)
            sketch = lambda x: np.add.reduceat(x, cuts, axis=1) if len(cuts) else np.zeros((len(x), 1))
            known, asked = sketch(curves), sketch(goals)
            for k, replicate in enumerate(replicates.tolist()):
                # Rounding must not lift a bound over the distance itself.
                low = np.abs(known - asked[k]).sum(axis=1) * width * (1 - 1e-9)
                best: list[tuple[float, int]] = []
                measured = 0
                for i in np.argsort(low, kind="stable"):
                    if len(best) >= closest and (not closest or low[i] > best[closest - 1][0]):
                        break
                    measured += 1
                    best.append((float(np.abs(curves[i] - goals[k]).sum() * width), int(sets[i])))
                    best.sort()
                    del best[closest:]
                lot = sorted((int.from_bytes(hashlib.md5(f"{seed}|diverse|{replicate}|{s}".encode()).digest()[:6], "big") / 2.0**48, s) for s in sets.tolist())[:others]
                rows = [(s, d, None) for d, s in best] + [(s, None, u) for u, s in lot]
                made["replicate"] += [replicate] * len(rows)
                for name, values in zip(("set_id", "wasserstein", "u"), zip(*rows)):
                    made[name] += values
                made["measured"] += [measured] + [0] * (len(rows) - 1)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(made.items(), kinds)})

    return run


def _tiled(cdfs: DataFrame, name: str, tiles: int) -> DataFrame:
    """(id, curve, tile): one array a CDF."""
    rows = cdfs.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("bin", "cdf"))).alias("c"))
    return rows.select(F.col(name).cast("int").alias(name), F.col("c.cdf").alias("curve"), F.pmod(F.xxhash64(name), F.lit(tiles)).cast("int").alias(f"{name}_tile"))


def candidates(seed_cdfs: DataFrame, replicate_cdfs: DataFrame, grid, closest: int, diverse: int, seed: int) -> DataFrame:
    """(replicate, set_id, wasserstein, u, measured): of every tile the nearest sets and the first by lot."""
    sets = max(1, -(-seed_cdfs.select("set_id").distinct().count() // TILE))
    replicates = max(1, -(-replicate_cdfs.select("replicate").distinct().count() // TILE))
    left = _tiled(replicate_cdfs, "replicate", replicates).withColumn("set_id_tile", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = _tiled(seed_cdfs, "set_id", sets).withColumn("replicate_tile", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    keys = ["replicate_tile", "set_id_tile"]
    # The lot is drawn over all sets, so the nearest ones must not use it up.
    others = closest + diverse if diverse else 0
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searcher(grid.width, closest, others, seed), SCHEMA)


def choose_seeds(seed_cdfs: DataFrame, replicate_cdfs: DataFrame, grid, closest: int, diverse: int, seed: int) -> DataFrame:
    """(replicate, restart, set_id, kind): the closest seed sets, then random others.

    ``seed_cdfs`` has (set_id, bin, cdf). Ties go to the lowest set id.
    """
    found = candidates(seed_cdfs, replicate_cdfs, grid, closest, diverse, seed)
    by_distance = W.partitionBy("replicate").orderBy("wasserstein", "set_id")
    near = found.where("wasserstein IS NOT NULL").withColumn("restart", (F.row_number().over(by_distance) - 1).cast("int")).where(F.col("restart") < closest)
    near = near.select("replicate", "restart", "set_id", F.lit("closest").alias("kind"))
    if not diverse:
        return near
    by_lot = W.partitionBy("replicate").orderBy("u", "set_id")
    rest = found.where("u IS NOT NULL").join(near.select("replicate", "set_id"), ["replicate", "set_id"], "left_anti")
    rest = rest.withColumn("turn", F.row_number().over(by_lot)).where(F.col("turn") <= diverse)
    return near.unionByName(rest.select("replicate", (F.lit(closest - 1) + F.col("turn")).cast("int").alias("restart"), "set_id", F.lit("diverse").alias("kind")))


# Workers get these functions whole, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
