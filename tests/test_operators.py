"""Hand values and brute-force checks of the relational operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coeval.functions import bits
from coeval.functions.age import Grid, interval_cdf
from coeval.functions.genotype import HETEROZYGOUS, INVALID, NON_BIALLELIC, decode_genotype, info_value
from coeval.functions.rng import derive_seed, uniform
from coeval.operators import bootstrap, catalog, cdf, coordinates, density, diversity, parents, ranks, resolution
from coeval.operators import spectrum, strata
from coeval.operators.coordinates import Chromosome
from coeval.plans import validation

INTERVALS = [(0, 0, 0.0, 10.0), (0, 1, 10.0, 20.0), (2, 0, 0.0, 10.0), (2, 0, 0.0, 20.0), (2, 1, 20.0, 30.0)]


@pytest.fixture(scope="module")
def intervals(spark):
    return spark.createDataFrame(INTERVALS, "row_id BIGINT, draw_id INT, below DOUBLE, above DOUBLE").cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_mean_age(intervals):
    assert rows(cdf.mean_age(intervals), "row_id", "mean_age") == [(0, 10.0), (2, pytest.approx(40 / 3))]
    assert dict(rows(cdf.mean_age(intervals, "draw"), "row_id", "mean_age"))[2] == 16.25


def test_cdf_weightings(intervals):
    at = cdf.cdf_at(intervals, [0.0, 5.0, 10.0, 15.0, 20.0])
    assert [r[1] for r in rows(at.where("row_id = 0"), "point_idx", "cdf")] == [0, 0.25, 0.5, 0.75, 1.0]
    assert rows(cdf.cdf_at(intervals, [10.0]).where("row_id = 2"), "cdf") == [(0.5,)]
    assert rows(cdf.cdf_at(intervals, [10.0], weighting="draw").where("row_id = 2"), "cdf") == [(0.375,)]


def test_many_points_take_the_long_plan_with_the_same_values(intervals):
    points = [0.4 * i for i in range(cdf.WIDE_POINTS + 1)]
    for weighting in ("interval", "draw"):
        wide = cdf.cdf_at(intervals, points[:40], weighting=weighting)
        long = cdf.cdf_at(intervals, points, weighting=weighting).where("point_idx < 40")
        a, b = rows(wide, "row_id", "point_idx", "cdf"), rows(long, "row_id", "point_idx", "cdf")
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-12)


def test_cell_masses(intervals):
    got = cdf.cell_masses(intervals, [0.0, 10.0, 20.0]).where("row_id = 0")
    assert rows(got, "cell", "mass") == [(0, 0.5), (1, 0.5)]
    with pytest.raises(ValueError):
        cdf.cell_masses(intervals, [0.0, 0.0])


def test_point_mass_sides(spark):
    ages = spark.createDataFrame([(9.0,), (10.0,), (11.0,)], "t DOUBLE")
    ten = F.lit(10.0)
    got = ages.select("t", interval_cdf(ten, ten, F.col("t"), "right").alias("r"), interval_cdf(ten, ten, F.col("t"), "left").alias("l"))
    assert rows(got, "t", "r", "l") == [(9.0, 0.0, 0.0), (10.0, 1.0, 0.0), (11.0, 1.0, 1.0)]


def test_grid_changes_equal_row_wise_values(spark, intervals):
    with_points = intervals.unionByName(
        spark.createDataFrame([(5, 0, 12.5, 12.5), (5, 0, 0.0, 25.0)], intervals.schema)
    )
    grid = Grid(2.5, 16)
    dense = dict(((r, b), c) for r, b, c in rows(cdf.row_grid_cdf(with_points, grid), "row_id", "bin", "cdf"))
    direct = cdf.cdf_at(with_points, grid.points(), side="left")
    for r, i, c in rows(direct, "row_id", "point_idx", "cdf"):
        assert dense[(r, i)] == pytest.approx(c, abs=1e-13)
    assert len(dense) == 3 * 16


def test_set_cdf_counts_repeats(spark, intervals):
    grid = Grid(5.0, 7)
    changes = cdf.row_changes(intervals, grid)
    members = spark.createDataFrame([(0, 0), (0, 0), (0, 2)], "set_id INT, row_id BIGINT")
    single = {(r, b): c for r, b, c in rows(cdf.row_grid_cdf(intervals, grid), "row_id", "bin", "cdf")}
    for b, c in rows(cdf.set_cdf(members, changes, grid, ["set_id"]), "bin", "cdf"):
        assert c == pytest.approx((2 * single[(0, b)] + single[(2, b)]) / 3, abs=1e-12)


def test_wasserstein_ignores_last_bin(spark):
    ages = [0.0, 1000.0, 2000.0, 5000.0]
    curves = {0: [1, 1, 1, 1], 1: [0, 1, 1, 1], 2: [0, 0, 0, 1]}
    data = [(s, a, float(c), 1.0) for s, cs in curves.items() for a, c in zip(ages, cs)]
    frame = spark.createDataFrame(data, "s INT, age DOUBLE, cdf DOUBLE, target_cdf DOUBLE")
    got = cdf.wasserstein_on_ages(frame, ["s"])
    assert rows(got, "s", "wasserstein") == [(0, 0.0), (1, 1000.0), (2, 5000.0)]


def test_binned_pdf_and_codes(spark):
    facts = spark.createDataFrame(
        [(0, 0, 0.0, 2000.0), (1, 0, 1500.0, 1500.0)], "row_id BIGINT, draw_id INT, below DOUBLE, above DOUBLE"
    )
    grid = Grid.spanning(2000.0, 1000.0)
    got = {(r, b): p for r, b, p in rows(density.binned_pdf(facts, grid, ["row_id"]), "row_id", "bin", "probability")}
    assert [got[(0, b)] for b in range(3)] == pytest.approx([0.25, 0.5, 0.25])
    assert [got[(1, b)] for b in range(3)] == pytest.approx([0, 0, 1])
    codes = density.quantise(cdf.row_grid_cdf(facts, grid), grid, ["row_id"])
    # 65535 / 4 = 16383.75 and 3 * 65535 / 4 = 49151.25
    assert rows(codes.where("row_id = 0"), "bin", "code") == [(0, 16384), (1, 49151), (2, 65535)]
    edges = density.boundary_codes(codes.where("row_id = 0"), [0, 1, 3], ["row_id"])
    assert rows(edges, "edge", "code") == [(0, 0), (1, 16384), (3, 65535)]


def test_grid_spanning():
    assert Grid.spanning(2500.0, 1000.0).centers() == [0, 1000, 2000, 3000]
    assert Grid.spanning(10.0, 1000.0).bins == 2
    assert Grid.spanning(2500.0, 1000.0).edges() == [-500, 500, 1500, 2500, 3500]


# --- Parents ------------------------------------------------------------------

EDGES = [(0.0, 50.0, 2, 0), (50.0, 100.0, 4, 0), (0.0, 100.0, 3, 2), (0.0, 100.0, 3, 4), (0.0, 100.0, 3, 1)]


@pytest.mark.parametrize("tile", [8, 64, 1 << 20])
def test_parent_lookup_edges_are_half_open(spark, tile):
    edges = spark.createDataFrame([(0, *e) for e in EDGES], "draw_id INT, `left` DOUBLE, `right` DOUBLE, parent BIGINT, child BIGINT")
    points = spark.createDataFrame([(0, 0, 10.0), (0, 0, 49.0), (0, 0, 50.0), (0, 0, 99.0), (0, 3, 70.0), (0, 0, 100.0)], "draw_id INT, child BIGINT, pos DOUBLE")
    got = {(r["child"], r["pos"]): r["parent"] for r in parents.parent_at(edges, points, tile).collect()}
    assert got == {(0, 10.0): 2, (0, 49.0): 2, (0, 50.0): 4, (0, 99.0): 4, (0, 100.0): None, (3, 70.0): None}


def test_parent_lookup_matches_brute_force(spark):
    rnd = random.Random(4)
    edges, points = [], set()
    for child in range(6):  # child 0 owns about a third of everything
        at = 0.0
        for _ in range(120 if child == 0 else 40):
            at += rnd.choice([0.5, 1.0, 7.25, 40.0])
            right = at + rnd.choice([0.5, 3.0, 300.0])
            edges.append((0, at, right, len(edges) + 100, child))
            at = right if rnd.random() < 0.7 else right + 5.5
        points |= {(0, child, float(rnd.randrange(0, 6000))) for _ in range(200)}
    expected = {}
    for _, child, pos in points:
        hit = [p for _, a, b, p, c in edges if c == child and a <= pos < b]
        expected[(child, pos)] = hit[0] if hit else None
    e = spark.createDataFrame(edges, "draw_id INT, `left` DOUBLE, `right` DOUBLE, parent BIGINT, child BIGINT")
    p = spark.createDataFrame(sorted(points), "draw_id INT, child BIGINT, pos DOUBLE")
    got = {(r["child"], r["pos"]): r["parent"] for r in parents.parent_at(e, p, 16.5).collect()}
    assert got == expected


def test_parent_audit_finds_every_wrong_answer(spark):
    edges = spark.createDataFrame([(0, 0.0, 5.0, 7, 1), (0, 5.0, 90.0, 8, 1)], "draw_id INT, `left` DOUBLE, `right` DOUBLE, parent BIGINT, child BIGINT")
    mutations = spark.createDataFrame([(0, 1, p) for p in (1, 1, 4, 5, 80, 95, 96, 60)], "draw_id INT, node_id BIGINT, position BIGINT")
    right = parents.mutation_parents(mutations, edges, 8)
    assert parents.parent_audit(mutations, edges, right, 8).count() == 0
    # One of two answers wrong, one null, one missing, one given where there is none, one for a point nobody asked for.
    spoiled = spark.createDataFrame([(0, 1, 1, 7), (0, 1, 1, 9), (0, 1, 4, None), (0, 1, 80, 8), (0, 1, 95, 8), (0, 1, 96, None), (0, 1, 60, 8), (0, 1, 60, 8), (0, 1, 2, 9)], "draw_id INT, node_id BIGINT, position BIGINT, parent BIGINT")
    assert rows(parents.parent_audit(mutations, edges, spoiled, 8), "position", "direct_parent") == [(1, 7), (4, 7), (5, 8), (95, None)]


def test_pairs_are_tallied_once(spark):
    members = spark.createDataFrame([(0, 1), (0, 2)], "set_id INT, row_id BIGINT")
    counts = spark.createDataFrame([(1, 5, 30), (2, 5, 30)], "row_id BIGINT, k BIGINT, n BIGINT")
    spectra, _ = spectrum.accumulate_spectra(members, counts, ["set_id"], ["row_id"])
    assert "Join LeftOuter" not in spectra._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_follow_the_input(spark):
    from coeval.session import SHUFFLE_BYTES, SHUFFLE_ROWS, fit_shuffles

    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    held = {n: spark.conf.get(n) for n in names}
    try:
        fit_shuffles(spark, 10)
        assert spark.conf.get(names[0]) == held[names[0]] and int(spark.conf.get(names[1]).rstrip("b")) == SHUFFLE_BYTES
        fit_shuffles(spark, 90 * SHUFFLE_ROWS + 1)
        assert spark.conf.get(names[0]) == "91"
        fit_shuffles(spark, 10)
        assert spark.conf.get(names[0]) == "91"
        spark.conf.set(names[1], "1m")
        fit_shuffles(spark, 10)
        assert spark.conf.get(names[1]) == "1m"
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def test_two_draw_store(spark):
    from coeval.plans.interval_store import check_inputs, interval_store_tables
    from coeval.session import RunFolder

    times = [(0, 0.0), (1, 0.0), (2, 20.0), (3, 100.0), (4, 30.0)]
    spans = [(0.0, 100.0, 2, 0), (0.0, 100.0, 3, 2), (0.0, 100.0, 3, 1)]
    nodes = spark.createDataFrame([(d, *t) for d in (0, 1) for t in times], "draw_id INT, node_id BIGINT, time DOUBLE")
    edges = spark.createDataFrame([(d, *e) for d in (0, 1) for e in spans], "draw_id INT, `left` DOUBLE, `right` DOUBLE, parent BIGINT, child BIGINT")
    sites = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, 10.0), (1, 1, 30.0)], "draw_id INT, site_id BIGINT, position DOUBLE")
    mutations = spark.createDataFrame(
        [(0, 0, 0, 2), (0, 1, 0, 0), (0, 2, 1, 3), (1, 0, 0, 0), (1, 1, 1, 2)], "draw_id INT, mutation_id BIGINT, site_id BIGINT, node_id BIGINT"
    )
    store = interval_store_tables(nodes, edges, sites, mutations, 2, RunFolder(spark))
    counters = ["row_id", "position", "present_draws", "usable_draws", "usable_intervals", "skipped_roots"]
    assert rows(store.sites, *counters) == [(0, 10, 2, 2, 3, 0), (1, 20, 1, 0, 0, 1), (2, 30, 1, 1, 1, 0)]
    ordered = catalog.mutation_order(store.intervals)
    assert rows(ordered, "row_id", "ord", "below", "above", "draw_id") == [
        (0, 0, 20.0, 100.0, 0), (0, 1, 0.0, 20.0, 0), (0, 2, 0.0, 20.0, 1), (2, 0, 20.0, 100.0, 1)
    ]
    wanted = store.sites.select(F.col("row_id").alias("row_order"), "row_id")
    cells = rows(catalog.read_status(store.status, [0, 1], wanted), "draw_id", "row_id", "status")
    assert [c[2] for c in cells] == [2, 1, 0, 2, 0, 2]
    check_inputs(sites, store)
    with pytest.raises(ValueError, match="absent"):
        check_inputs(sites, store, missing="error")
    with pytest.raises(ValueError, match="root"):
        check_inputs(sites, store, root="error")
    with pytest.raises(ValueError, match="fractional"):
        check_inputs(sites.withColumn("position", F.col("position") + 0.5), store)


def test_requests_are_answered_whole_and_in_order(spark):
    rnd = random.Random(3)
    facts = [(row, d, m, float(m), float(m + d + 1)) for m, (row, d) in enumerate((rnd.choice([1, 1, 1, 2, 5]), rnd.randrange(4)) for _ in range(90))]
    asked = [(i, rnd.choice([1, 2, 3, 5])) for i in range(40)]
    frame = spark.createDataFrame(facts, "row_id BIGINT, draw_id INT, mutation_id BIGINT, below DOUBLE, above DOUBLE").repartition(3)
    requests = spark.createDataFrame(rnd.sample(asked, len(asked)), "request_index INT, row_id BIGINT").repartition(5)
    got = resolution.gather_intervals(requests, frame, piece=7).collect()
    # rows come in request order, a request's pieces one after the other
    assert [(r["request_index"], r["piece"]) for r in got] == sorted((r["request_index"], r["piece"]) for r in got)
    assert all(len(r["intervals"]) <= 7 for r in got)
    answers = {}
    for r in got:
        answers.setdefault((r["request_index"], r["row_id"]), []).extend(tuple(x) for x in r["intervals"])
    assert answers == {(i, row): sorted(f[1:] for f in facts if f[0] == row) for i, row in asked}


def test_layouts_of_a_dense_store_hold_the_same_cells(spark):
    codes = spark.range(300).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(299))).alias("bin"))
    codes = codes.withColumn("code", F.least(F.lit(65535), F.col("bin") * 300 + F.col("row_id").cast("int")))
    turned = codes.repartition(7, "bin").sortWithinPartitions("bin", "row_id")
    assert validation.bad_layouts(codes, turned).isEmpty()
    flipped = turned.withColumn("code", F.when((F.col("row_id") == 17) & (F.col("bin") == 200), F.col("code") + 1).otherwise(F.col("code")))
    assert [tuple(r)[:2] for r in validation.bad_layouts(codes, flipped).collect()] == [(0, 1)]
    assert [tuple(r) for r in validation.bad_layouts(codes, turned.where("NOT (row_id = 3 AND bin = 299)")).collect()] == [(0, 2, 300 * 44, 300 * 44 - 1)]
    # a swap of two codes leaves counts and the set of codes as they are
    swapped = turned.withColumn("row_id", F.when((F.col("bin") == 0) & (F.col("row_id") < 2), 1 - F.col("row_id")).otherwise(F.col("row_id")))
    assert [tuple(r)[:2] for r in validation.bad_layouts(codes, swapped).collect()] == [(0, 0)]


def test_empty_rows_end_at_zero_only_without_intervals(spark):
    codes = spark.createDataFrame([(r, b, c) for r, cs in enumerate([(0, 9), (0, 0), (0, 0), (5, 3)]) for b, c in enumerate(cs)], "row_id BIGINT, bin INT, code INT")
    sites = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 1)], "row_id BIGINT, usable_intervals BIGINT")
    assert {r["row_id"] for r in validation.bad_codes(codes, 2, 9).collect()} == {3}
    assert {r["row_id"] for r in validation.bad_codes(codes, 2, 9, sites).collect()} == {2, 3}


def test_status_packing_round_trip(spark):
    status = spark.createDataFrame([(0, i, i % 3) for i in range(10)], "draw_id INT, row_id BIGINT, status INT")
    packed = bits.pack_status(status)
    assert dict(rows(packed, "byte_idx", "packed"))[0] == 0 + (1 << 2) + (2 << 4)
    assert rows(bits.unpack_status(packed, 10), "row_id", "status") == [(i, i % 3) for i in range(10)]


# --- Ranks and skew -------------------------------------------------------------


def test_dense_row_ids_over_tiles(spark):
    values = sorted(random.Random(1).sample(range(5000), 400))
    frame = spark.createDataFrame([(x,) for x in values], "position BIGINT")
    assert rows(ranks.dense_row_ids(frame, 64), "position", "row_id") == [(x, i) for i, x in enumerate(values)]


def test_smallest_by_key_is_exact_for_a_huge_group(spark):
    sizes = {0: 4000, 1: 50, 2: 3}
    data = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g INT, row_id BIGINT")
    keyed = data.withColumn("key", uniform("t", F.col("g"), F.col("row_id"))).cache()
    kept = ranks.smallest_by_key(keyed, ["g"], "key", "row_id", F.lit(37))
    expected = {}
    for r in keyed.collect():
        expected.setdefault(r["g"], []).append((r["key"], r["row_id"]))
    wanted = sorted((g, i) for g, ks in expected.items() for _, i in sorted(ks)[:37])
    assert rows(kept, "g", "row_id") == wanted


def test_ordinals_in_one_group(spark):
    data = spark.range(1000).select(F.lit(7).alias("row_id"), (F.col("id") % 3).alias("draw_id"), F.col("id").alias("mutation_id"))
    got = [m for _, m in sorted((r["ord"], (r["draw_id"], r["mutation_id"])) for r in ranks.ordinal_in_group(data, ["row_id"], ["draw_id", "mutation_id"], "mutation_id", 50).collect())]
    assert got == sorted(got) and len(got) == 1000


def test_quantile_is_an_observed_value(spark):
    values = spark.range(100).select(F.col("id").cast("double").alias("w"))
    assert ranks.empirical_quantile(values, "w", 0.95).first()["threshold"] == 95.0
    with pytest.raises(ValueError):
        ranks.empirical_quantile(values, "w", 1.0)


def test_coalesced_slabs_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(diversity, "SLAB_TILE", 10)
    chosen = sorted(random.Random(3).sample(range(400), 90))
    frame = spark.createDataFrame([(x,) for x in chosen], "row_id BIGINT")
    runs = [[chosen[0], chosen[0], 1]]
    for x in chosen[1:]:
        if x - runs[-1][1] > 4:
            runs.append([x, x, 0])
        runs[-1][1] = x
        runs[-1][2] += 1
    got = rows(diversity.coalesced_slabs(frame, 3), "first_row", "last_row", "requested")
    assert got == sorted(map(tuple, runs))


def test_running_best_over_tiles(spark):
    rnd = random.Random(8)
    values = [rnd.random() for _ in range(200)]
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(values)], "job INT, epoch BIGINT, wasserstein DOUBLE")
    got = rows(bootstrap.running_best(frame, ["job"], 16), "epoch", "best_distance", "improvement")
    best = [min(values[: i + 1]) for i in range(200)]
    assert [g[1] for g in got] == best
    assert [g[2] for g in got] == pytest.approx([0.0] + [best[i - 1] - best[i] for i in range(1, 200)])


def test_counter_draws_do_not_depend_on_partitions(spark):
    base = spark.range(500)
    draw = uniform(3, "x", F.col("id")).alias("u")
    assert rows(base.repartition(7).select("id", draw), "id", "u") == rows(base.coalesce(1).select("id", draw), "id", "u")
    assert derive_seed(1, "a") == derive_seed(1, "a") != derive_seed(2, "a")


# --- Coordinates and resolution --------------------------------------------------


def test_native_and_global(spark):
    table = [Chromosome("chr1", 0, 100), Chromosome("chr2", 101, 100)]
    coordinates.validate_chromosomes(table)
    frame = coordinates.chromosome_frame(spark, table)
    asked = spark.createDataFrame([("chr1", 100), ("chr2", 1), ("chr2", 101), ("chrX", 1)], "chrom STRING, native BIGINT")
    got = {(r["chrom"], r["native"]): (r["position"], r["problem"]) for r in coordinates.native_to_global(asked, frame).collect()}
    assert got[("chr1", 100)] == (100, None) and got[("chr2", 1)] == (102, None)
    assert got[("chr2", 101)][1] == "position out of range" and got[("chrX", 1)][1] == "unknown chromosome"
    sites = spark.createDataFrame([(1,), (100,), (101,), (102,), (201,), (202,)], "position BIGINT")
    back = rows(coordinates.global_to_native(sites, frame), "position", "chrom", "native")
    assert back == [(1, "chr1", 1), (100, "chr1", 100), (101, None, None), (102, "chr2", 1), (201, "chr2", 100), (202, None, None)]
    for bad in ([], [Chromosome("a", 0, 5), Chromosome("a", 9, 5)], [Chromosome("a", 0, 5), Chromosome("b", 4, 5)], [Chromosome("a", 0, 0)]):
        with pytest.raises(ValueError):
            coordinates.validate_chromosomes(bad)


def test_unequal_intervals_are_listed_twice_at_most(spark):
    rnd, table, at = random.Random(2), [], 0
    for i in range(60):
        at += rnd.choice([0, 1, 1000])
        length = rnd.choice([1, 2, 10, 1023, 1024, 1025, 10**9])
        table.append(Chromosome(f"c{i}", at, length))
        at += length
    frame = coordinates.chromosome_frame(spark, table)
    listed = coordinates.interval_levels(frame)
    assert max(r["count"] for r in listed.groupBy("chrom").count().collect()) <= 2
    ends = {p for c in table for p in (c.offset, c.offset + 1, c.offset + c.length, c.offset + c.length + 1, c.offset + rnd.randint(1, c.length))}
    sites = spark.createDataFrame([(p,) for p in sorted(ends)], "position BIGINT")
    want = [(p, *next(((c.chrom, p - c.offset) for c in table if c.offset < p <= c.offset + c.length), (None, None))) for p in sorted(ends)]
    assert rows(coordinates.global_to_native(sites, frame), "position", "chrom", "native") == want


def test_resolution(spark):
    sites = spark.createDataFrame([(0, 10, True), (1, 20, False), (2, 30, True), (3, 50, True)], "row_id BIGINT, position BIGINT, eligible BOOLEAN")
    asked = spark.createDataFrame([(0, 50), (1, 15), (2, 20), (3, 10)], "request_index INT, position BIGINT")
    found = resolution.resolve(asked, sites)
    assert [tuple(r) for r in found.orderBy("request_index").select("row_id", "resolved", "eligible", "reason").collect()] == [
        (3, True, True, None), (None, False, False, "unresolved"), (1, True, False, "ineligible"), (0, True, True, None)
    ]
    summary = resolution.summarize(found).first()
    assert (summary["requested"], summary["resolved"], summary["unresolved"], summary["eligible"], summary["ineligible"], summary["excluded"]) == (4, 3, 1, 2, 1, 2)
    assert resolution.enforce_policy(found, "drop").count() == 2
    with pytest.raises(ValueError, match="1 unresolved and 1 ineligible"):
        resolution.enforce_policy(found, "error")
    with pytest.raises(ValueError, match="no eligible"):
        resolution.enforce_policy(found.where("NOT eligible"), "drop")


# --- Strata, quotas, bootstrap ---------------------------------------------------


def test_strata_compress_repeated_edges(spark):
    target = spark.createDataFrame([(0, 0.0), (1, 0.6), (2, 0.6), (3, 1.0)], "bin INT, target_cdf DOUBLE")
    edges = strata.equal_mass_edges(target, Grid(1000.0, 4))
    assert [r[0] for r in rows(edges, "edge")] == [0, 2, 4]
    assert [r[0] for r in rows(edges, "label_age")] == [0.0, 1000.0, 3000.0]
    spans = strata.strata(edges)
    assert [r[1] for r in rows(spans, "stratum", "share")] == pytest.approx([0.6, 0.4])


def test_first_bin_mass_is_covered(spark):
    target = spark.createDataFrame([(0, 0.3), (1, 0.5), (2, 0.95), (3, 1.0)], "bin INT, target_cdf DOUBLE")
    edges = [r[0] for r in rows(strata.equal_mass_edges(target, Grid(1.0, 4)), "edge")]
    assert edges[0] == 0 and edges[-1] == 4


def test_quotas(spark):
    shares = spark.createDataFrame([(i, 0.05) for i in range(20)], "stratum INT, share DOUBLE")
    quotas = [r[1] for r in rows(strata.largest_remainder(shares, 503), "stratum", "quota")]
    assert sum(quotas) == 503 and set(quotas) == {25, 26} and quotas[:3] == [26, 26, 26]


def test_bootstrap_support(spark):
    # two targets whose curves differ in one bin of width 1000
    facts = spark.createDataFrame([(4, 0, 0.0, 1.0, 1), (9, 0, 1600.0, 1601.0, 1)], "row_id BIGINT, draw_id INT, below DOUBLE, above DOUBLE, usable_intervals BIGINT")
    grid = Grid(1000.0, 3)
    rows_ = bootstrap.index_targets(facts.select("row_id"))
    changes = cdf.row_changes(facts, grid)
    draws = bootstrap.Draws(spark, 2, 40, 5)
    counts = bootstrap.bootstrap_counts(draws)
    assert {r["draws"] for r in bootstrap.replicate_sizes(counts).collect()} == {2}
    observed = cdf.set_cdf(facts.select("row_id", F.lit(0).alias("s")), changes, grid, ["s"]).select("bin", F.col("cdf").alias("target_cdf"))
    found = bootstrap.replicate_distances(draws, rows_, changes, observed, grid).collect()
    assert len(found) == 40 and {round(r["wasserstein"], 6) for r in found} == {0.0, 1000.0}


@pytest.mark.parametrize("block,span,drawn", [(256, 1 << 16, 1 << 12), (3, 8, 5)])
def test_bootstrap_product_matches_brute_force(spark, monkeypatch, block, span, drawn):
    """Counts, CDFs and distances from counters in plain Python, with one tile and with many."""
    for name, value in (("BLOCK", block), ("SPAN", span), ("DRAWN", drawn)):
        monkeypatch.setattr(bootstrap, name, value)
    rnd, size, replicates = random.Random(4), 21, 11
    ages = [(3 * i + 1, 0, below := rnd.uniform(0, 5000), below + rnd.uniform(10, 4000), 1) for i in range(size)]
    facts = spark.createDataFrame(ages, "row_id BIGINT, draw_id INT, below DOUBLE, above DOUBLE, usable_intervals BIGINT")
    grid = Grid(500.0, 20)
    rows_, changes = bootstrap.index_targets(facts.select("row_id")), cdf.row_changes(facts, grid)
    observed = cdf.set_cdf(facts.select("row_id", F.lit(0).alias("s")), changes, grid, ["s"]).select("bin", F.col("cdf").alias("target_cdf"))
    draws = bootstrap.Draws(spark, size, replicates, 9)
    number = lambda r, i: int(hashlib.md5(f"9|bootstrap|{r}|{i}".encode()).hexdigest()[:12], 16) / 16**12
    picks = [[int(number(r, i) * size) for i in range(size)] for r in range(replicates)]
    counts = {(r["replicate"], r["target_idx"]): r["times"] for r in bootstrap.bootstrap_counts(draws).collect()}
    assert counts == {(r, t): p.count(t) for r, p in enumerate(picks) for t in set(p)}
    curves = np.array([[min(1.0, max(0.0, (x - below) / (above - below))) for x in grid.points()] for _, _, below, above, _ in ages])
    means = {(r["replicate"], r["bin"]): r["cdf"] for r in bootstrap.replicate_cdfs(draws, rows_, changes, grid).collect()}
    assert len(means) == replicates * grid.bins
    far = {r["replicate"]: r["wasserstein"] for r in bootstrap.replicate_distances(draws, rows_, changes, observed, grid).collect()}
    for r, p in enumerate(picks):
        mean = curves[p].mean(axis=0)
        assert np.allclose([means[r, b] for b in range(grid.bins)], mean, atol=1e-12)
        assert abs(far[r] - np.abs((mean - curves.mean(axis=0))[:-1]).sum() * grid.width) < 1e-8


def test_ten_thousand_replicates(spark):
    size = 300
    facts = spark.range(size).select(F.col("id").alias("row_id"), F.lit(0).alias("draw_id"), (F.col("id") * 10.0).alias("below"), (F.col("id") * 11.0 + 700.0).alias("above"), F.lit(1).cast("bigint").alias("usable_intervals"))
    grid = Grid(100.0, 45)
    rows_, changes = bootstrap.index_targets(facts.select("row_id")), cdf.row_changes(facts, grid)
    observed = cdf.set_cdf(facts.select("row_id", F.lit(0).alias("s")), changes, grid, ["s"]).select("bin", F.col("cdf").alias("target_cdf"))
    draws = bootstrap.Draws(spark, size, 10_000, 1)
    assert draws.packed().count() == draws.blocks == 40
    far = bootstrap.replicate_distances(draws, rows_, changes, observed, grid)
    summary = far.agg(F.count("*"), F.count_distinct("replicate"), F.avg("wasserstein"), F.max("wasserstein")).first()
    assert summary[0] == summary[1] == 10_000 and 0 < summary[2] < summary[3] < 1000


# --- Genotypes and spectra -------------------------------------------------------


def test_genotypes(spark):
    calls = ["0", "1", "0/0", "1|1", "0|1", "./.", "0/.", "1/1/1", "2/2", "a/b", "", "00", "01/1"]
    frame = spark.createDataFrame([(c,) for c in calls], "gt STRING")
    got = {r["gt"]: r["a"] for r in frame.select("gt", decode_genotype(F.col("gt")).alias("a")).collect()}
    assert got == {
        "0": 0, "1": 1, "0/0": 0, "1|1": 1, "0|1": HETEROZYGOUS, "./.": None, "0/.": None, "1/1/1": 1,
        "2/2": NON_BIALLELIC, "a/b": INVALID, "": INVALID, "00": 0, "01/1": 1,
    }
    lenient = frame.select("gt", decode_genotype(F.col("gt"), "missing").alias("a")).where("gt = '0|1'")
    assert lenient.first()["a"] is None


def test_info(spark):
    frame = spark.createDataFrame([("A=1;B=2;A=x=y",), ("FLAG;B=2",), (".",), ("A",)], "info STRING")
    assert [r[0] for r in frame.select(info_value(F.col("info"), "A")).collect()] == ["x=y", None, None, None]


def test_projection_values(spark):
    counts = spark.createDataFrame([(7, 20), (1, 21), (500, 1000), (3, 10)], "k BIGINT, n BIGINT")
    long = {(k, j): m for k, j, m in rows(spectrum.project_long(counts), "k", "bin", "mass")}
    assert long[(7, 7)] == pytest.approx(1.0) and long[(7, 6)] == 0.0
    assert long[(1, 0)] == pytest.approx(1 / 21) and long[(1, 1)] == pytest.approx(20 / 21)
    assert sum(long[(500, j)] for j in range(21)) == pytest.approx(1.0, abs=1e-12)
    assert (3, 0) not in long


def test_phi_hand_values(spark):
    from coeval.plans import phi
    from coeval.session import RunFolder

    counts = spark.createDataFrame([(10, 4, 20), (20, 8, 20), (30, 4, 20), (40, 12, 20), (50, 5, 10)], "pos BIGINT, k BIGINT, n BIGINT")
    everyone = spark.createDataFrame([(-1, 10), (-1, 20), (0, 30), (0, 40), (1, 40), (1, 50)], "set_id INT, pos BIGINT")
    got = phi.from_counts(everyone, counts, ["pos"], RunFolder(spark)).replicates
    assert rows(got, "set_id", "phi_sfs", "eligible_sites", "dropped") == [(0, pytest.approx(0.5), 2, 0), (1, pytest.approx(1.0), 1, 1)]
    lonely = spark.createDataFrame([(-1, 10), (0, 50)], "set_id INT, pos BIGINT")
    with pytest.raises(ValueError, match="retained mass"):
        phi.from_counts(lonely, counts, ["pos"], RunFolder(spark))


def test_replacement(spark):
    current = spark.createDataFrame([(0, r) for r in (1, 2, 5, 6)], "s INT, row_id BIGINT")
    reference = spark.createDataFrame([(0, r) for r in (1, 2, 3, 4)], "s INT, row_id BIGINT")
    assert diversity.replacement_fraction(current, reference, ["s"]).first()["replacement"] == 0.5


def test_quality_flags_of_prices_that_are_no_numbers(spark, tmp_path):
    from workload.matching import quality_flags

    prices = [float("nan"), float("inf"), float("-inf"), 1e300, -10.5, 1500.5, None]
    spark.createDataFrame([(i, 1, p) for i, p in enumerate(prices)], "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE").write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(quality_flags(spark, str(tmp_path)), "id", "error_ratio", "qc_pass")
    assert np.isnan(got[0][1]) and got[0][2] is False
    assert got[1:] == [(1, float("inf"), False), (2, float("-inf"), True), (3, 1e300 / 1000.0, False), (4, -1.0, True), (5, 1.0, False), (6, None, None)]


def test_interval_counts_equal_the_joined_intervals(spark):
    rng = random.Random(5)
    edges, nodes, mutations = [], [(0, 100 + i, 50.0 + i) for i in range(40)], []
    for child in range(6):
        cuts = sorted({16.0 * rng.randint(0, 6), *(rng.randint(0, 120) / 2 for _ in range(6))})
        edges += [(0, child, a, b if rng.random() < 0.7 else (a + b) / 2, 100 + rng.randint(0, 45)) for a, b in zip(cuts, cuts[1:])]
        nodes += [(0, child, float(child))] * (child < 5)
        mutations += [(0, child, rng.randint(-5, 70)) for _ in range(30)] + [(0, child, 16)] * 3
    mutations += [(0, None, 20), (1, 0, 20)]
    e = spark.createDataFrame(edges + [(0, None, 0.0, 90.0, 101)], "draw_id INT, child BIGINT, left DOUBLE, right DOUBLE, parent BIGINT")
    n = spark.createDataFrame(nodes, "draw_id INT, node_id BIGINT, time DOUBLE")
    m = spark.createDataFrame(mutations, "draw_id INT, node_id BIGINT, position BIGINT")
    joined = parents.with_ages(parents.mutation_parents(m, e, 16), n).where("above IS NOT NULL")
    want = joined.groupBy("draw_id", "below", "above").count()
    got = parents.interval_counts(m, e, n, 16).groupBy("draw_id", "below", "above").agg(F.sum("times"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and want.count() > 20
