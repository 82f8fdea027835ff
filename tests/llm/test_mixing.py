import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coeval.llm.mixing import mixed, source_targets


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, active = share * sum(sizes.values()), {}, set(sizes)
    while active:
        level = left / sum(weight[s] for s in active)
        above = {s for s in active if level * weight[s] >= most * sizes[s]}
        if not above:
            out |= {s: level * weight[s] for s in active}
            break
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        active -= above
    return out


def rows_of(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["a", "b", "é", "z", None, "Z", "q"])
        rows.append((i, " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 5))), source))
    return rows + [(n, None, "a"), (n + 1, "", "only empty"), (n + 2, " \t\n", None), (None, "x y z", "a"), rows[3]]


@pytest.mark.parametrize("seed,slices", [(1, 5_000), (2, 20)])
def test_targets_are_met(spark, monkeypatch, seed, slices):
    import coeval.llm.mixing as mixing

    monkeypatch.setattr(mixing, "SLICE_ROWS", slices)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("p", F.lit("p")).withColumn("target", F.lit("old"))
    got = mixed(df.repartition(5)).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        n = len((r["text"] or "").split())
        assert r["size"] == n and 0 <= r["copies"] <= 2 and r["p"] == "p"
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], n)
    want = filled(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    again = mixed(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_random_odds_favour_nobody(spark):
    rows = [(i, "a b", "s") for i in range(4000)] + [(10_000 + i, "a b", "t") for i in range(1000)]
    got = mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    halves = [sum(r["copies"] for r in got if r["source"] == "s" and (r["doc_id"] < 2000) == first) for first in (True, False)]
    assert abs(halves[0] - halves[1]) < 200


def test_water_filling(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 700, None: 40}, {"a": 1}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 10**12}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got == pytest.approx(filled(sizes))


def test_empty_table(spark):
    assert mixed(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []
