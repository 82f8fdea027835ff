"""Samplers against brute force and their own guarantees."""

import bisect
import collections
import dataclasses
import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coeval.functions.age import Grid
from coeval.functions.rng import permutation_domain, permuted
from coeval.operators import cdf
from coeval.plans import blocks, matcher, nearest, rejection, replay, setlog, swap, validation
from coeval.plans.target import TargetConfig, build_target
from coeval.session import RunFolder

N, X = 240, 30


@pytest.fixture(scope="module")
def store(spark):
    """240 sites of one to three intervals; thirty young ones are targets."""
    rnd = random.Random(11)
    data = []
    for row in range(N):
        for draw in range(1 + row % 3):
            below = rnd.uniform(0, 9000) * (0.6 if row < X else 1.0)
            data.append((row, draw, below, below + rnd.uniform(200, 4000)))
    facts = spark.createDataFrame(data, "row_id BIGINT, draw_id INT, below DOUBLE, above DOUBLE")
    facts = cdf.with_counts(facts).cache()
    sites = spark.range(N).select(F.col("id").alias("row_id"), F.lit(True).alias("eligible"))
    targets = spark.range(X).select(F.col("id").alias("row_id"))
    pool = spark.range(X, N).select(F.col("id").alias("row_id"))
    oldest = max(r[3] for r in data)
    run = RunFolder(spark)
    config = TargetConfig(500.0, 80, 0.9, 4)
    return facts, sites, targets, pool, oldest, build_target(facts, targets, oldest, config, run)


def _profile(rnd, bins):
    below = rnd.uniform(0, bins - 3)
    above = below + rnd.uniform(0.5, 3)
    p, q = math.ceil(below), math.ceil(above)
    changes = {0: np.zeros(3)}
    for at, values in ((p, (1 / (above - below), -below / (above - below), 0)), (q, (-1 / (above - below), below / (above - below), 1))):
        if at < bins:
            changes[at] = changes.get(at, np.zeros(3)) + np.array(values, dtype=float)
    keys = sorted(changes)
    return [keys] + [[changes[k][i] for k in keys] for i in range(3)]


def _items(rnd, slots, offers, bins):
    records = []
    for i in range(slots):
        records.append([0, 0, replay.SLOT, rnd.random(), i, i, True, *_profile(rnd, bins)])
    for i in range(offers):
        records.append([0, 0, replay.OFFER, rnd.random(), rnd.randrange(slots), 1000 + i, False, *_profile(rnd, bins)])
    names = ["job", "block", "kind", "ord", "slot", "row_id", "inside", "bins", "slopes", "intercepts", "completes"]
    return pd.DataFrame(records, columns=names)


SHAPE = ["bins", "slopes", "intercepts", "completes"]


def _curve(row, bins):
    return replay.curve(*[getattr(row, c) for c in SHAPE], bins)


def _start(items, goal, bins):
    held = {r.slot: (r.row_id, _curve(r, bins)) for r in items.itertuples() if r.kind == replay.SLOT}
    return held, lambda: np.abs((np.mean([c for _, c in held.values()], axis=0) - goal)[:-1]).sum()


def test_one_block_improves_in_order():
    rnd, bins, slots = random.Random(5), 12, 15
    items, goal = _items(rnd, slots, 60, bins), np.linspace(0.1, 1, bins)
    held, distance = _start(items, goal, bins)
    mean = np.mean([c for _, c in held.values()], axis=0)
    out = replay.block_runner(1.0, 0.0, 0.0)(items, pd.DataFrame({"residual": [mean - goal]}))
    order = [r.slot for r in items[items.kind == replay.SLOT].sort_values("ord").itertuples()]
    accepted = 0
    for slot, offer in zip(order, items[items.kind == replay.OFFER].sort_values("ord").itertuples()):
        before, old = distance(), held[slot]
        held[slot] = (offer.row_id, _curve(offer, bins))
        if distance() < before:
            accepted += 1
        else:
            held[slot] = old
    tally = out[out.slot == -1].iloc[0]
    assert (tally.accepted, tally.tried) == (accepted, slots)
    assert {r.slot: r.row_id for r in out.itertuples() if r.slot >= 0} == {s: r for s, (r, _) in held.items() if r != s}


def test_walk_is_the_sequential_rule():
    rnd, bins, slots = random.Random(5), 12, 15
    items, goal = _items(rnd, slots, 60, bins), np.linspace(0.1, 1, bins)
    # rows drawn twice, and rows that the set holds, are redrawn while it does
    again = items[items.kind == replay.OFFER].iloc[:20].copy()
    again["ord"] += 1
    inside = items[items.kind == replay.SLOT].copy()
    inside["kind"], inside["ord"], inside["slot"] = replay.OFFER, [rnd.random() * 2 for _ in range(slots)], [rnd.randrange(slots) for _ in range(slots)]
    items = pd.concat([items, again, inside], ignore_index=True)
    held, distance = _start(items, goal, bins)
    mean = np.mean([c for _, c in held.values()], axis=0)
    limit = np.abs((mean - goal)[:-1]).sum() * 1.2
    for required in (9, 1000):
        held, distance = _start(items, goal, bins)
        frame = pd.DataFrame({"residual": [mean - goal], "limit": [limit], "required": [required], "size": [slots]})
        out = replay.walk_runner(1.0)(items, frame)
        accepted = tried = 0
        for offer in items[items.kind == replay.OFFER].sort_values("ord").itertuples():
            if accepted == required:
                break
            if offer.row_id in {r for r, _ in held.values()}:
                continue
            tried += 1
            old = held[offer.slot]
            held[offer.slot] = (offer.row_id, _curve(offer, bins))
            if distance() <= limit:
                accepted += 1
            else:
                held[offer.slot] = old
        tally = out[out.slot == -1].iloc[0]
        assert (tally.accepted, tally.tried) == (accepted, tried)
        changed = {r.slot: r.row_id for r in out.itertuples() if r.slot >= 0}
        assert {s: changed.get(s, s) for s in range(slots)} == {s: r for s, (r, _) in held.items()}


@pytest.mark.parametrize("proposals", [1, 4, 64])
def test_walk_visits_feasible_sets_alike(proposals):
    """Occupancy of a small pool by chi-square, whatever the length of a round."""
    rnd, bins, pool, size = random.Random(proposals), 8, 7, 3
    shapes = [_profile(rnd, bins) for _ in range(pool)]
    curves = [replay.curve(*p, bins) for p in shapes]
    goal = np.mean(curves, axis=0)
    gap = lambda rows: np.mean([curves[r] for r in rows], axis=0) - goal
    far = lambda rows: np.abs(gap(rows)[:-1]).sum()
    every = list(itertools.combinations(range(pool), size))
    limit = sorted(map(far, every))[2 * len(every) // 3]
    feasible = {frozenset(c) for c in every if far(c) <= limit}
    state = list(min(every, key=far))
    names = ["job", "kind", "ord", "slot", "row_id", "inside", *SHAPE]
    runner, seen, steps = replay.walk_runner(1.0), {}, 0
    # every 64th proposal is counted, so that counts are close to independent
    while steps < 64 * 600:
        offers = [[0, replay.OFFER, float(i), rnd.randrange(size), r, r in state] for i, r in enumerate(rnd.randrange(pool) for _ in range(proposals))]
        slots = [[0, replay.SLOT, 0.0, s, r, True] for s, r in enumerate(state)]
        items = pd.DataFrame([[*x, *shapes[x[4]]] for x in slots + offers], columns=names)
        goals = pd.DataFrame({"residual": [gap(state)], "limit": [limit], "required": [10**6], "size": [size]})
        for r in runner(items, goals).itertuples():
            if r.slot >= 0:
                state[r.slot] = r.row_id
        steps += proposals
        if steps % 64 == 0:
            key = frozenset(state)
            seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= feasible
    expected = sum(seen.values()) / len(feasible)
    chi = sum((seen.get(f, 0) - expected) ** 2 / expected for f in feasible)
    # five standard deviations above its mean
    assert chi < (len(feasible) - 1) + 5 * math.sqrt(2 * (len(feasible) - 1))


def test_offers_give_every_slot_another_candidate(spark, store):
    _, _, _, pool, _, _ = store
    run = RunFolder(spark)
    state = run.table("state", blocks.first_state(pool, [0, 1], X, 3))
    offers = blocks._offers(state, blocks.indexed(pool), N - X, [0, 1], X, 3, "t").collect()
    held = {(r["job"], r["row_id"]) for r in state.collect()}
    assert sorted((r["job"], r["slot"]) for r in offers) == [(j, s) for j in (0, 1) for s in range(X)]
    rows = [(r["job"], r["row_id"]) for r in offers]
    assert len(set(rows)) == 2 * X and not set(rows) & held
    domain = permutation_domain(N - X)
    numbers = spark.range(domain).select(permuted(F.col("id"), domain, "seed").alias("p")).collect()
    assert sorted(r["p"] for r in numbers) == list(range(domain))


def _applied(run, state, swaps):
    log = setlog.SetLog(run, "applied", state, state.count())
    log.append(swaps, 0)
    return log.current()


def _distances(state, changes, target, jobs):
    means = blocks.job_cdfs(state, changes, target.grid)
    aims = blocks.for_every_job(target.cdf, jobs)
    return {r["job"]: r["wasserstein"] for r in blocks.job_distances(means, aims, target.grid).collect()}


@pytest.mark.parametrize("slots", [7, 1000])
def test_blocks_together_keep_the_guarantee(spark, store, slots):
    facts, _, _, pool, _, target = store
    run = RunFolder(spark)
    changes = run.table("changes", cdf.row_changes(facts, target.grid))
    profiles = run.table("profiles", cdf.profiles(changes))
    jobs = [0, 1]
    state = run.table("state", blocks.first_state(pool, jobs, X, 3))
    before = _distances(state, changes, target, jobs)
    residuals = blocks.residual_arrays(
        blocks.job_cdfs(state, changes, target.grid), blocks.for_every_job(target.cdf, jobs)
    )
    swaps = run.table(
        "swaps",
        blocks.improve_round(
            state, blocks.indexed(pool), N - X, profiles, residuals, target.grid, jobs, X, 3, "t", blocks.BlockConfig(slots)
        ),
    )
    after_state = run.table("after", _applied(run, state, swaps))
    after = _distances(after_state, changes, target, jobs)
    counts = blocks.tallies(swaps)
    for job in jobs:
        assert counts[job][0] > 0 and counts[job][1] == X
        assert after[job] <= before[job] + 1e-9
    held = after_state.groupBy("job").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d")).collect()
    assert all(r["n"] == r["d"] == X for r in held)
    if slots == 7:
        assert swaps.where("slot < 0").groupBy("job").count().where("count >= 4").count() == 2


@pytest.mark.parametrize("proposals", [5, 200])
def test_walk_round_stays_within_the_limit(spark, store, proposals):
    facts, _, _, pool, _, target = store
    run = RunFolder(spark)
    changes = run.table("changes", cdf.row_changes(facts, target.grid))
    profiles = run.table("profiles", cdf.profiles(changes))
    state = run.table("state", blocks.first_state(pool, [0, 1], X, 3))
    limit = max(_distances(state, changes, target, [0, 1]).values()) + 50.0
    goals = blocks.residual_arrays(
        blocks.job_cdfs(state, changes, target.grid), blocks.for_every_job(target.cdf, [0, 1])
    ).withColumns({"limit": F.lit(limit), "required": F.lit(X)})
    listed = run.table("indexed", blocks.indexed(pool))
    swaps = run.table("swaps", blocks.walk_round(state, listed, N - X, profiles, goals, target.grid, [0, 1], X, 3, "t", proposals))
    after_state = run.table("after", _applied(run, state, swaps))
    assert max(_distances(after_state, changes, target, [0, 1]).values()) <= limit + 1e-9
    counts = blocks.tallies(swaps)
    assert all(0 < counts[j][0] <= min(X, counts[j][1]) and counts[j][1] <= proposals for j in (0, 1))
    held = after_state.groupBy("job").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d")).collect()
    assert all(r["n"] == r["d"] == X for r in held)


def test_log_of_swaps_equals_rewritten_sets(spark, store, monkeypatch):
    """Sets and running CDFs after rounds of random swaps, with and without new bases, against plain Python."""
    monkeypatch.setattr(setlog, "MOST_ENTRIES", 3)
    facts, _, _, pool, _, target = store
    run, rnd, jobs = RunFolder(spark), random.Random(3), [0, 1, 2]
    changes = run.table("changes", cdf.row_changes(facts, target.grid))
    state = run.table("state", blocks.first_state(pool, jobs, X, 3))
    held = {(r["job"], r["slot"]): r["row_id"] for r in state.collect()}
    log = setlog.SetLog(run, "sets", state, 10**6)
    running = setlog.RunningCdfs(run, "sums", state, changes, target.grid, X)
    versions = [dict(held)]
    for turn in range(7):
        touched = rnd.sample(sorted(held), 5 if turn % 2 else 1)
        rows = []
        for job, slot in touched:
            new = rnd.choice(sorted(set(range(X, N)) - {r for (j, _), r in held.items() if j == job}))
            rows.append((job, 0, slot, new, held[job, slot]))
            held[job, slot] = new
        swaps = run.table(f"swaps-{turn}", spark.createDataFrame(rows, "job INT, block INT, slot BIGINT, row_id BIGINT, old_id BIGINT"))
        log.append(swaps, len(rows))
        running.advance(swaps)
        versions.append(dict(held))
    assert log.compactions == 2
    flat = lambda df: {(r["job"], r["slot"]): r["row_id"] for r in df.collect()}
    assert flat(log.current()) == held
    assert flat(log.at({0: 2, 1: 7, 2: 0})) == {k: versions[{0: 2, 1: 7, 2: 0}[k[0]]][k] for k in held}
    far = running.cdfs().withColumnRenamed("cdf", "kept").join(blocks.job_cdfs(log.current(), changes, target.grid), ["job", "bin"])
    assert far.where(F.abs(F.col("kept") - F.col("cdf")) > 1e-10).count() == 0 and far.count() == 3 * target.grid.bins


def test_swaps_end_with_the_first_that_suffices():
    rnd, bins, size = random.Random(9), 10, 12
    goal = np.linspace(0.1, 1, bins)
    records, curves = [], {}
    for turn in range(size):
        for kind in (replay.SLOT, replay.OFFER):
            shape = _profile(rnd, bins)
            curves[turn, kind] = replay.curve(*shape, bins)
            records.append([0, turn % 3, turn, turn, kind, 100 * kind + turn, *shape])
    items = pd.DataFrame(records, columns=["job", "block", "slot", "turn", "kind", "row_id", *SHAPE]).sample(frac=1, random_state=1)
    gaps = [np.mean([curves[t, replay.SLOT] for t in range(size)], axis=0) - goal]
    for t in range(size):
        gaps.append(gaps[-1] + (curves[t, replay.OFFER] - curves[t, replay.SLOT]) / size)
    far = [np.abs(g[:-1]).sum() for g in gaps]
    for limit in [*far, 0.0]:
        frame = pd.DataFrame({"residual": [gaps[0]], "limit": [limit + 1e-12], "size": [size]})
        out = replay.prefix_runner(1.0)(items, frame)
        kept = next((k for k, d in enumerate(far) if d <= limit + 1e-12), size)
        assert list(out[out.slot >= 0].slot) == list(range(kept))
        assert list(out[out.slot >= 0].old_id) == list(range(kept)) and out[out.slot < 0].accepted.iloc[0] == kept


def test_stretches_of_swaps_end_where_one_task_would(spark, monkeypatch):
    rnd, bins, size = random.Random(5), 10, 12
    run, grid = RunFolder(spark), Grid(1.0, bins)
    shapes = [(i, *[list(map(float, a)) if n else list(map(int, a)) for n, a in enumerate(_profile(rnd, bins))]) for i in range(2 * size)]
    profiles = spark.createDataFrame(shapes, "row_id BIGINT, bins ARRAY<INT>, slopes ARRAY<DOUBLE>, intercepts ARRAY<DOUBLE>, completes ARRAY<DOUBLE>")
    curves = [replay.curve(*s[1:], bins) for s in shapes]
    rows = [(0, t % 3, t, size + t, t, t // 3) for t in range(size)]
    swaps = spark.createDataFrame(rows, "job INT, block INT, slot BIGINT, row_id BIGINT, old_id BIGINT, turn BIGINT")
    gaps = [np.mean(curves[:size], axis=0) - np.linspace(0.1, 1, bins)]
    for t in range(size):
        gaps.append(gaps[-1] + (curves[size + t] - curves[t]) / size)
    far = [np.abs(g[:-1]).sum() for g in gaps]
    monkeypatch.setattr(blocks, "PREFIX_SWAPS", 1)
    for at, limit in enumerate([*sorted(far)[:3], 0.0]):
        if far[0] <= limit + 1e-9:
            continue
        goals = spark.createDataFrame([(0, [float(x) for x in gaps[0]], float(limit + 1e-9))], "job INT, residual ARRAY<DOUBLE>, limit DOUBLE")
        got = blocks.shortest_prefix(swaps, size, profiles, goals, grid, size, blocks.BlockConfig(12), run, f"cut-{at}").collect()
        kept = next((k for k, d in enumerate(far) if d <= limit + 1e-9), size)
        assert sorted(r["slot"] for r in got if r["slot"] >= 0) == list(range(kept))
        assert sum(r["accepted"] for r in got if r["slot"] < 0) == kept
        assert {r["block"] for r in got} == set(range(-(-kept // 3)))


def test_a_walk_round_moves_no_table(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = spark.range(50).selectExpr("0 AS job", "id AS slot", "id AS row_id")
        pool = spark.range(100).selectExpr("id AS idx", "id AS row_id")
        profiles = spark.range(100).selectExpr("id AS row_id", "array(0) AS bins", "array(0D) AS slopes", "array(0D) AS intercepts", "array(1D) AS completes")
        goals = spark.createDataFrame([(0, [0.0, 0.0], 1.0, 5)], "job INT, residual ARRAY<DOUBLE>, limit DOUBLE, required INT")
        swaps = blocks.walk_round(state, pool, 100, profiles, goals, Grid(1.0, 2), [0], 50, 3, "t", 64)
        assert "SortMergeJoin" not in swaps._jdf.queryExecution().executedPlan().toString()
        assert sum(r["accepted"] for r in swaps.collect()) == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_chain_near_its_threshold_stops_within_an_epoch(spark, store):
    facts, _, _, pool, oldest, target = store
    wide = dataclasses.replace(target, threshold=2.0 * target.threshold)
    config = swap.SwapConfig(chains=2, sets_per_chain=1, construction=swap.Construction(bin_width=1000))
    made = swap.run_chains(facts, pool, wide, oldest, 4, config, RunFolder(spark))
    last = {r["chain_index"]: r for r in made.construction}
    assert all(r["exact_wasserstein"] <= wide.threshold for r in last.values())
    assert any(r["accepted_swaps"] < r["passing_swaps"] for r in last.values())


def test_chains_are_certified_and_repeatable(spark, store):
    facts, sites, targets, pool, oldest, target = store
    config = swap.SwapConfig(chains=2, sets_per_chain=2, construction=swap.Construction(bin_width=4000), blocks=blocks.BlockConfig(16))
    keys = ["chain_index", "sample_index"]
    first = swap.run_chains(facts, pool, target, oldest, 9, config, RunFolder(spark))
    validation.require_none(validation.bad_members(first.members, sites, targets, keys, X, pool), "members")
    changes = cdf.row_changes(facts, target.grid)
    means = cdf.set_cdf(first.members, changes, target.grid, keys)
    scores = cdf.wasserstein(means, target.cdf, target.grid, keys)
    validation.require_none(validation.bad_distances(first.sets, scores, keys, target.threshold), "distances")
    for record in first.diagnostics:
        assert record["accepted_swaps"] >= record["required_accepted_swaps"] == X
        assert 0 < record["replacement_fraction"] <= min(1.0, record["accepted_sweeps"])
    broken = first.sets.withColumn("wasserstein", F.col("wasserstein") + 1)
    assert validation.bad_distances(broken, scores, keys).count() == 4
    spoiled = first.members.limit(1).withColumn("row_id", F.lit(0).cast("bigint")).unionByName(first.members)
    found = {r["problem"] for r in validation.bad_members(spoiled, sites, targets, keys, X, pool).collect()}
    assert {"target row", "wrong size"} <= found
    again = swap.run_chains(
        facts.repartition(5), pool.repartition(3), target, oldest, 9, config, RunFolder(spark)
    )
    assert first.members.exceptAll(again.members).count() == 0


def test_search_grid_is_refined_on_a_plateau(spark, store):
    facts, _, _, pool, oldest, target = store
    # so wide a grid sees no difference at all between sets
    config = swap.SwapConfig(chains=1, sets_per_chain=1, construction=swap.Construction(bin_width=64_000, epochs=30))
    made = swap.run_chains(facts, pool, target, oldest, 2, config, RunFolder(spark))
    widths = [r["search_bin_width"] for r in made.construction]
    assert widths == sorted(widths, reverse=True)
    with pytest.raises(ValueError, match="finer"):
        swap.run_chains(facts, pool, target, oldest, 2, swap.SwapConfig(construction=swap.Construction(bin_width=100)), RunFolder(spark))
    small = pool.limit(X)
    with pytest.raises(swap.SwapSamplingError):
        swap.run_chains(facts, small, target, oldest, 2, swap.SwapConfig(construction=swap.Construction(bin_width=4000)), RunFolder(spark))


def _number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def _brute_draw(weights, quotas, proposal, seed):
    """Strata in turn; each takes the first free rows of its draws, then of its race, where draws may run out."""
    own = {s: sorted((r, w) for r, q, w in weights if q == s) for s in quotas}

    def draws(s, count):
        total = math.fsum(w for _, w in own[s])
        ends = list(itertools.accumulate(max(1, round(w / total * rejection.WEIGHT_UNITS)) for _, w in own[s]))
        xs = [min(int(_number(seed, "draw", proposal, s, at) / 16**12 * ends[-1]), ends[-1] - 1) for at in range(count)]
        return [own[s][bisect.bisect_right(ends, x)][0] for x in xs]

    def race(s):
        return [r for _, r in sorted((-math.log((_number(seed, "race", proposal, s, r) + 0.5) / 16**12) / w, r) for r, w in own[s])]

    more = lambda x: math.ceil(x * rejection.FIRST_DRAWS) + rejection.SPARE_DRAWS
    length, raced = {s: more(q) for s, q in quotas.items()}, set()
    while True:
        gone, taken, short = set(), set(), {}
        for s in sorted(quotas, key=lambda s: _number(seed, "turn", proposal, s)):
            stream = draws(s, length[s]) + (race(s) if s in raced else [])
            picked = [r for r in dict.fromkeys(stream) if r not in gone][: quotas[s]]
            gone.update(picked)
            taken |= {(proposal, r, s) for r in picked}
            if len(picked) < quotas[s] and s not in raced:
                short[s] = len(picked)
        if not short:
            return taken
        for s, got in short.items():
            longer = length[s] + more(length[s] * (quotas[s] - got) / max(got, 1))
            if longer >= len(own[s]):
                raced.add(s)
            length[s] = max(length[s], min(longer, len(own[s])))


@pytest.mark.parametrize("rows,spare", [(40, 16), (400, 16), (400, 0)])
def test_rejection_draw_matches_brute_force(spark, monkeypatch, rows, spare):
    """Streams that suffice, streams that are drawn on, and ones that end in a race."""
    monkeypatch.setattr(rejection, "SPARE_DRAWS", spare)
    monkeypatch.setattr(rejection, "INDEX_TILE", 16)
    rnd = random.Random(6)
    weights = [(r, s, rnd.uniform(0.05, 1) ** 3) for r in range(rows) for s in range(3) if rnd.random() < 0.8]
    frame = spark.createDataFrame(weights, "row_id BIGINT, stratum INT, weight DOUBLE").repartition(3)
    quotas = {0: 9, 1: 4, 2: 17}
    strata = spark.createDataFrame(list(quotas.items()), "stratum INT, quota BIGINT")
    run = RunFolder(spark)
    drawn, short = rejection.draw_sets(frame, rejection.weight_index(frame, run), strata, 1, 4, 21, run)
    assert short.count() == 0
    expected = set().union(*[_brute_draw(weights, quotas, p, 21) for p in (1, 2, 3, 4)])
    got = [tuple(r) for r in drawn.select("proposal_id", "row_id", "stratum").collect()]
    assert len(got) == 4 * 30 and set(got) == expected


def test_rejection_draw_follows_the_law(spark):
    """Frequencies of whole sets against all orders of successive draws without replacement."""
    weights = {0: {1: 5.0, 2: 1.0, 3: 1.0, 4: 0.2}, 1: {2: 2.0, 4: 3.0, 5: 0.5}}
    quotas, proposals = {0: 2, 1: 1}, 3000
    rows = [(r, s, w) for s, x in weights.items() for r, w in x.items()]
    frame = spark.createDataFrame(rows, "row_id BIGINT, stratum INT, weight DOUBLE")
    strata = spark.createDataFrame(list(quotas.items()), "stratum INT, quota BIGINT")
    law = collections.Counter()

    def follow(turns, left, sets, odds):
        if not turns:
            law[tuple(sorted(sets))] += odds
            return
        s, gone = turns[0], {r for r, _ in sets}
        free = {r: w for r, w in weights[s].items() if r not in gone}
        for r, w in free.items():
            rest = left - 1
            more = turns if rest else turns[1:]
            follow(more, rest or (quotas[more[0]] if more else 0), [*sets, (r, s)], odds * w / sum(free.values()))

    for turns in ((0, 1), (1, 0)):
        follow(list(turns), quotas[turns[0]], [], 0.5)
    run = RunFolder(spark)
    drawn, short = rejection.draw_sets(frame, rejection.weight_index(frame, run), strata, 1, proposals, 5, run)
    assert short.count() == 0
    found = collections.defaultdict(list)
    for r in drawn.collect():
        found[r["proposal_id"]].append((r["row_id"], r["stratum"]))
    seen = collections.Counter(tuple(sorted(x)) for x in found.values())
    assert set(seen) <= set(law) and abs(sum(law.values()) - 1) < 1e-9
    chi = sum((seen[k] - proposals * p) ** 2 / (proposals * p) for k, p in law.items() if proposals * p >= 5)
    assert chi < 2 * len(law) + 20


def test_rejection_draw_makes_rows_for_the_set_not_the_pool(spark):
    pool, quota = 20_000, 50
    frame = spark.range(pool).select(F.col("id").alias("row_id"), F.lit(0).alias("stratum"), (F.col("id") % 7 + 1).cast("double").alias("weight"))
    # One row holds a third of all weight.
    frame = frame.withColumn("weight", F.when(F.col("row_id") == 11, 40_000.0).otherwise(F.col("weight")))
    strata = spark.createDataFrame([(0, quota)], "stratum INT, quota BIGINT")
    run = RunFolder(spark)
    index = rejection.weight_index(frame, run)
    assert index[0].count() <= 2 * pool
    spans = index[0].select("lo", "hi", "row_id").distinct().orderBy("lo").collect()
    assert spans[0]["lo"] == 0 and all(a["hi"] == b["lo"] for a, b in zip(spans, spans[1:])) and len(spans) == pool
    drawn, short = rejection.draw_sets(frame, index, strata, 1, 8, 3, run)
    assert short.count() == 0 and drawn.count() == 8 * quota
    made = sum(spark.read.parquet(f"{run.path}/draw-1/stream-{k}").count() for k in range(6) if run._exists(f"{run.path}/draw-1/stream-{k}"))
    assert made <= 3 * 8 * quota


def test_rejection_reports_short_strata(spark):
    frame = spark.createDataFrame([(r, 0, 1.0) for r in range(3)], "row_id BIGINT, stratum INT, weight DOUBLE")
    strata = spark.createDataFrame([(0, 5), (1, 2)], "stratum INT, quota BIGINT")
    run = RunFolder(spark)
    _, short = rejection.draw_sets(frame, rejection.weight_index(frame, run), strata, 1, 2, 1, run)
    assert sorted(tuple(r) for r in short.collect()) == [(1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 1, 2)]
    target = spark.createDataFrame([(0, 0.5), (1, 1.0)], "bin INT, target_cdf DOUBLE")
    changes = spark.createDataFrame([(r, 0, 0.0, 1.0, 0.0) for r in range(3)], "row_id BIGINT, bin INT, slope DOUBLE, intercept DOUBLE, complete DOUBLE")
    with pytest.raises(rejection.SamplingError, match="0 of 1"):
        rejection.generate_matches(frame, strata, changes, target, Grid(1.0, 2), 1.0, 1, 4, 1, RunFolder(spark))


@pytest.mark.parametrize("tile,stretches", [(64, 64), (4, 3)])
def test_nearest_seeds_are_exact_and_few_are_measured(spark, monkeypatch, tile, stretches):
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "STRETCHES", stretches)
    rnd, bins, grid = random.Random(8), 30, Grid(10.0, 30)
    curve = lambda shift: np.clip(np.linspace(-shift, 1.2, bins) + np.sort([rnd.uniform(0, 0.05) for _ in range(bins)]), 0, 1)
    sets, goals = {s: curve(s / 20) for s in range(20)}, {r: curve(r / 12) for r in range(9)}
    sets[20], sets[3] = sets[7], sets[7]
    frame = lambda curves, name: spark.createDataFrame([(k, b, float(x)) for k, c in curves.items() for b, x in enumerate(c)], f"{name} INT, bin INT, cdf DOUBLE").repartition(3)
    args = frame(sets, "set_id"), frame(goals, "replicate"), grid
    got = {(r["replicate"], r["restart"]): (r["set_id"], r["kind"]) for r in nearest.choose_seeds(*args, 3, 2, 6).collect()}
    assert len(got) == 9 * 5
    for r, goal in goals.items():
        order = sorted(sets, key=lambda s: (np.abs(sets[s] - goal)[:-1].sum() * grid.width, s))
        rest = sorted(order[3:], key=lambda s: (_number(6, "diverse", r, s), s))
        want = [(s, "closest") for s in order[:3]] + [(s, "diverse") for s in rest[:2]]
        assert [got[r, k] for k in range(5)] == want
    measured = nearest.candidates(*args, 3, 2, 6).agg(F.sum("measured")).first()[0]
    assert measured < (0.6 if tile == 64 else 0.95) * 9 * len(sets)


def test_matcher_improves_and_certifies(spark, store):
    facts, sites, targets, pool, oldest, target = store
    seeds = blocks.first_state(pool, [0, 1, 2], X, 8).select(F.col("job").alias("set_id"), "row_id")
    config = matcher.OptimizerConfig(
        replicates=2, bin_width=1000.0, seeds=matcher.Seeds(1, 1), stopping=matcher.Stopping(2, 4, 1), blocks=blocks.BlockConfig(16),
    )
    found = matcher.match_replicates(facts, pool, target, seeds, oldest, 5, config, RunFolder(spark))
    validation.require_none(
        validation.bad_members(found.members, sites, targets, ["replicate"], X, pool), "members"
    )
    restarts = found.restarts.collect()
    assert len(restarts) == 4 and {r["kind"] for r in restarts} == {"closest", "diverse"}
    assert all(r["match_bootstrap"] <= r["initial"] for r in restarts)
    for r in found.replicates.collect():
        rivals = [s["match_bootstrap"] for s in restarts if s["replicate"] == r["replicate"]]
        assert r["match_bootstrap"] == min(rivals)
    traces = {}
    for t in found.traces.orderBy("job", "epoch").collect():
        traces.setdefault(t["job"], []).append(t["best_distance"])
    assert all(d == sorted(d, reverse=True) for d in traces.values())
    with pytest.raises(ValueError, match="outside the candidates"):
        outside = seeds.withColumn("row_id", F.when(F.col("set_id") == 0, F.col("row_id") - N).otherwise(F.col("row_id")))
        matcher.match_replicates(facts, pool, target, outside, oldest, 5, config, RunFolder(spark))


def test_configurations_are_checked():
    for bad in (dict(chains=0), dict(sets_per_chain=0), dict(walk=swap.Walk(burnin=0)), dict(construction=swap.Construction(bin_width=0))):
        with pytest.raises(ValueError):
            swap.SwapConfig(**bad).validate()
    stops = [matcher.Stopping(least=9, most=3), matcher.Stopping(patience=0), matcher.Stopping(material=-1.0)]
    for bad in (dict(replicates=0), dict(seeds=matcher.Seeds(0, 0)), *[dict(stopping=x) for x in stops], dict(tolerance=matcher.Tolerance(relative=-1.0)), dict(quality=matcher.Quality(ratio=0.0))):
        with pytest.raises(ValueError):
            matcher.OptimizerConfig(**bad).validate()
    with pytest.raises(ValueError):
        TargetConfig(acceptance_distance=-1.0).validate()


def test_offers_of_a_short_pool_reach_all_slots_in_turn(spark):
    size, total = 12, 15
    run = RunFolder(spark)
    pool = run.table("short-pool", spark.range(total).select(F.col("id").alias("row_id")))
    state = run.table("short-state", blocks.first_state(pool, [0, 1], size, 3))
    index, held = run.table("short-index", blocks.indexed(pool)), {(r["job"], r["row_id"]) for r in state.collect()}
    reached = {0: set(), 1: set()}
    for k in range(14):
        offers = blocks._offers(state, index, total, [0, 1], size, 3, f"t{k}").collect()
        rows, slots = {(r["job"], r["row_id"]) for r in offers}, {(r["job"], r["slot"]) for r in offers}
        assert len(offers) == len(rows) == len(slots) == 2 * (total - size) and not rows & held
        for job, slot in slots:
            reached[job].add(slot)
    # One in fourteen rounds takes three of twelve slots: each is missed by all with odds of one in fifty.
    assert all(len(s) >= size - 2 for s in reached.values()) and len(reached[0] | reached[1]) == size
