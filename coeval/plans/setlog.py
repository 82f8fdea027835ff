"""Sets of many jobs as a base table, a log of swaps, and running sums of their changes.

A round of a sampler touches few of a set's slots. It appends its swaps here, so
what it writes follows the swaps; the base is written anew only once the log has
grown to a share of it. A set's mean CDF is kept as its summed changes: a swap
adds those of the row that comes and takes off those of the row that goes. Sums
drift by rounding alone, and every set that is saved is certified from its members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.operators import cdf
from coeval.plans.blocks import looked_up
from coeval.session import RunFolder

#: Log entries, and their swaps over the base's slots, at which the base is written anew.
MOST_ENTRIES, MOST_SHARE = 16, 0.5

NAMES = ("slope", "intercept", "complete")


class SetLog:
    """(job, slot, row_id) of sets that change by swaps."""

    def __init__(self, run: RunFolder, name: str, base: DataFrame, slots: int) -> None:
        self.run, self.name, self.slots = run, name, slots
        self.first = self.base = base
        self.entries: list[tuple[int, DataFrame]] = []
        self.open, self.pending, self.compactions = 0, 0, 0

    def append(self, swaps: DataFrame, count: int) -> None:
        """Add a round's written swaps (job, slot, row_id), each slot of a job at most once."""
        changed = swaps.where("slot >= 0").select("job", "slot", "row_id")
        self.entries.append((len(self.entries) + 1, changed))
        self.open += 1
        self.pending += count
        if self.open >= MOST_ENTRIES or self.pending > MOST_SHARE * self.slots:
            self.compact()

    def compact(self) -> None:
        """Write the sets as they are now as the new base."""
        self.compactions += 1
        self.base = self.run.table(f"{self.name}-base-{self.compactions}", self.current())
        self.open = self.pending = 0

    def current(self) -> DataFrame:
        """The sets as they are now."""
        return self._after(self.base, self.entries[len(self.entries) - self.open :])

    def at(self, entry: dict[int, int]) -> DataFrame:
        """Each listed job's set as it was after so many entries."""
        chosen = self.run.spark.createDataFrame(list(entry.items()), "job INT, _until INT")
        log = [(k, e.join(F.broadcast(chosen), "job").where(F.col("_until") >= k).drop("_until")) for k, e in self.entries]
        # One row a job, which the driver has listed.
        return self._after(self.first.join(F.broadcast(chosen.select("job")), "job", "left_semi"), log)

    @staticmethod
    def _after(base: DataFrame, log: list[tuple[int, DataFrame]]) -> DataFrame:
        if not log:
            return base
        every = reduce(DataFrame.unionByName, [e.withColumn("_entry", F.lit(k)) for k, e in log])
        latest = every.groupBy("job", "slot").agg(F.max_by("row_id", "_entry").alias("_new"))
        return base.join(latest, ["job", "slot"], "left").select("job", "slot", F.coalesce("_new", "row_id").alias("row_id"))


def moved_changes(swaps: DataFrame, changes: DataFrame, size: int, count: int | None = None) -> DataFrame:
    """(job, bin, slope, intercept, complete): what swaps (job, slot, row_id, old_id) add to their sets' mean changes.

    A known small ``count`` of swaps is broadcast, so the changes are read where they lie.
    """
    signed = F.explode(F.array(F.struct(F.col("row_id"), F.lit(1.0).alias("_sign")), F.struct(F.col("old_id").alias("row_id"), F.lit(-1.0).alias("_sign"))))
    rows = swaps.where("slot >= 0").select("job", signed.alias("x")).select("job", "x.*")
    if count is not None:
        rows = looked_up(rows, 2 * count)
    return rows.join(changes, "row_id").groupBy("job", "bin").agg(*[(F.sum(F.col(c) * F.col("_sign")) / size).alias(c) for c in NAMES])


class RunningCdfs:
    """Mean CDFs of all sets on one grid, kept as summed changes."""

    def __init__(self, run: RunFolder, name: str, sets: DataFrame, changes: DataFrame, grid: Grid, size: int) -> None:
        self.run, self.name, self.changes, self.grid, self.size, self.step = run, name, changes, grid, size, 0
        self.sums = run.table(f"{name}-0", cdf.set_changes(sets.select("job", "row_id"), changes, ["job"]).select("job", "bin", *NAMES))

    def advance(self, swaps: DataFrame, count: int | None = None) -> None:
        """Follow a round's ``count`` written swaps (job, slot, row_id, old_id)."""
        self.step += 1
        both = self.sums.unionByName(moved_changes(swaps, self.changes, self.size, count))
        self.sums = self.run.table(f"{self.name}-{self.step}", both.groupBy("job", "bin").agg(*[F.sum(c).alias(c) for c in NAMES]))

    def cdfs(self, jobs: list[int] | None = None) -> DataFrame:
        """(job, bin, cdf) of the listed jobs, or of all."""
        sums = self.sums if jobs is None else self.sums.where(F.col("job").isin(jobs))
        return cdf.accumulate(sums, self.grid, ["job"])
