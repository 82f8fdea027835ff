"""One accept/reject block, replayed in order over columns of a single task.

Everything that grows with the data happens outside: Spark draws the
proposals, assigns slots and proposals to blocks, joins the profiles and sends
one bounded block here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SLOT, OFFER = 0, 1
#: A row a swap, with its turn among the block's swaps; then one of slot -1 with counts and, from a walk, the residual.
OUTPUT = "job INT, block INT, slot BIGINT, row_id BIGINT, old_id BIGINT, turn BIGINT, accepted BIGINT, tried BIGINT, redrawn BIGINT, residual ARRAY<DOUBLE>"
#: Bytes of dense curves that a walk keeps.
CURVE_BYTES = 64 << 20


def curve(bins, slopes, intercepts, completes, size: int) -> np.ndarray:
    """Dense CDF of a profile: accumulate its changes over the grid."""
    dense = np.zeros((3, size))
    dense[:, np.asarray(bins, dtype=np.int64)] = slopes, intercepts, completes
    line = np.cumsum(dense, axis=1)
    return np.clip(np.arange(size) * line[0] + line[1] + line[2], 0.0, 1.0)


def block_runner(width: float, absolute: float, relative: float):
    """Function for a cogrouped block: (items, goal) to the block's swaps.

    Each slot is paired with one offer; a swap stays that lowers the distance by
    more than the tolerance.
    """

    def run(items: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        if items.empty or goal.empty:
            return _result(0, 0, [], 0, 0).iloc[:0]
        job, block = int(items["job"].iloc[0]), int(items["block"].iloc[0])
        gap = np.asarray(goal["residual"].iloc[0], dtype=np.float64).copy()
        size = gap.size
        slots = items[items["kind"] == SLOT].sort_values(["ord", "row_id"])
        offers = items[items["kind"] == OFFER].sort_values(["ord", "row_id"])
        n = len(slots)
        distance = np.abs(gap[:-1]).sum() * width
        tried, swapped = 0, []
        for old, new in zip(slots.itertuples(index=False), offers.itertuples(index=False)):
            tried += 1
            trial = gap + (_curve_of(new, size) - _curve_of(old, size)) / n
            moved = np.abs(trial[:-1]).sum() * width
            if moved < distance - max(absolute, relative * max(distance, 1.0)):
                gap, distance = trial, moved
                swapped.append((old.slot, new.row_id, old.row_id))
        return _result(job, block, swapped, len(swapped), tried)

    return run


def walk_runner(width: float):
    """Function for one chain's round: (items, goal) to the swaps of its proposals.

    Proposals are tried one after the other against the whole set's residual: a
    random slot, a random candidate, and the swap stays if the set keeps within
    the limit. A candidate that the set holds at its turn is not a proposal but
    a redraw. The round ends early at the required number of accepted swaps.
    How many proposals a round has changes nothing else, since the next round
    goes on from where this one ended.
    """

    def run(items: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        if items.empty or goal.empty:
            return _result(0, 0, [], 0, 0).iloc[:0]
        gap = np.asarray(goal["residual"].iloc[0], dtype=np.float64).copy()
        size, n = gap.size, int(goal["size"].iloc[0])
        limit, wanted = float(goal["limit"].iloc[0]), int(goal["required"].iloc[0])
        slots = {r.slot: r for r in items[items["kind"] == SLOT].itertuples(index=False)}
        first = {s: r.row_id for s, r in slots.items()}
        curves, most = {}, max(2, CURVE_BYTES // (8 * size))
        entered, gone = set(), set()
        accepted = tried = redrawn = 0
        for offer in items[items["kind"] == OFFER].sort_values("ord").itertuples(index=False):
            if accepted >= wanted:
                break
            if offer.row_id in entered or (offer.inside and offer.row_id not in gone):
                redrawn += 1
                continue
            at = offer.slot
            if at not in curves:
                if len(curves) >= most:
                    curves.clear()
                curves[at] = _curve_of(slots[at], size)
            tried += 1
            new = _curve_of(offer, size)
            trial = gap + (new - curves[at]) / n
            if np.abs(trial[:-1]).sum() * width <= limit:
                leaves = slots[at].row_id
                entered.discard(leaves)
                gone.add(leaves)
                gone.discard(offer.row_id)
                entered.add(offer.row_id)
                gap, slots[at], curves[at] = trial, offer, new
                accepted += 1
        swapped = [(s, r.row_id, first[s]) for s, r in slots.items() if r.row_id != first[s]]
        return _result(int(items["job"].iloc[0]), 0, swapped, accepted, tried, redrawn, gap)

    return run


def prefix_runner(width: float):
    """Function for a stretch of a job's accepted swaps: (items, goal) to the swaps that stay.

    Swaps are applied in turn to the exact residual. From the first prefix that
    is within the limit on, the rest is left out; without one all stay. The
    stretch's number comes back as the block, and ``tried`` says whether it got
    within the limit.
    """

    def run(items: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        if items.empty or goal.empty:
            return _result(0, 0, [], 0, 0).iloc[:0]
        gap = np.asarray(goal["residual"].iloc[0], dtype=np.float64).copy()
        size, n, limit = gap.size, int(goal["size"].iloc[0]), float(goal["limit"].iloc[0])
        kept = []
        within = np.abs(gap[:-1]).sum() * width <= limit
        ordered = items.sort_values(["turn", "block", "slot", "kind"])
        for old, new in zip(ordered[ordered["kind"] == SLOT].itertuples(index=False), ordered[ordered["kind"] == OFFER].itertuples(index=False)):
            if within:
                break
            gap += (_curve_of(new, size) - _curve_of(old, size)) / n
            kept.append((new.slot, new.row_id, old.row_id))
            within = np.abs(gap[:-1]).sum() * width <= limit
        part = int(items["part"].iloc[0]) if "part" in items else 0
        return _result(int(items["job"].iloc[0]), part, kept, len(kept), int(within))

    return run


def _curve_of(row, size: int) -> np.ndarray:
    return curve(row.bins, row.slopes, row.intercepts, row.completes, size)


def _result(job: int, block: int, swapped: list, accepted: int, tried: int, redrawn: int = 0, residual=None) -> pd.DataFrame:
    """One row a changed slot, then one with the counts."""
    rows = [(job, block, slot, row, old, turn, 0, 0, 0, None) for turn, (slot, row, old) in enumerate(swapped)]
    counts = (job, block, -1, -1, -1, -1, accepted, tried, redrawn, residual)
    return pd.DataFrame([*rows, counts], columns=["job", "block", "slot", "row_id", "old_id", "turn", "accepted", "tried", "redrawn", "residual"])
