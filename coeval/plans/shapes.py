"""Per-width CDF changes of the rows a sampler can meet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from coeval.functions.age import Grid
from coeval.operators import cdf
from coeval.plans.target import Target, mean_target
from coeval.session import RunFolder


class Shapes:
    """Changes, profiles and target of each grid width, written once and reused.

    Only candidates and targets are kept: a store holds many times more sites
    than a sampler can use.
    """

    def __init__(
        self, intervals: DataFrame, candidates: DataFrame, target: Target, maximum: float, run: RunFolder
    ) -> None:
        useful = candidates.select("row_id").unionByName(target.rows.select("row_id")).distinct()
        self.intervals = intervals.join(useful, "row_id", "left_semi")
        self.target, self.maximum, self.run = target, maximum, run
        self.known: dict[float, tuple[Grid, DataFrame, DataFrame, DataFrame]] = {}

    def at(self, width: float) -> tuple[Grid, DataFrame, DataFrame, DataFrame]:
        """(grid, changes, profiles, target CDF) at this width."""
        if width not in self.known:
            grid, run = Grid.spanning(self.maximum, width), self.run
            changes = run.table(f"changes-{width:g}", cdf.row_changes(self.intervals, grid))
            profiles = run.table(f"profiles-{width:g}", cdf.profiles(changes))
            if width == self.target.grid.width:
                goal = self.target.cdf
            else:
                goal = run.table(f"target-{width:g}", mean_target(self.target.rows, changes, grid))
            self.known[width] = (grid, changes, profiles, goal)
        return self.known[width]
