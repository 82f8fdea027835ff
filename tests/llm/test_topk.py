import math
import random

import pytest
from pyspark.sql import functions as F

from coeval.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, every):
    import numpy as np

    held = {}
    for key, v, _ in rows:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * float(np.float32(x))) for x in v]
        held[key] = min(held.get(key, q), q)
    out = []
    for a, x in held.items():
        if a % every == 0:
            ranked = sorted((-sum(p * q for p, q in zip(x, y)), b) for b, y in held.items() if b != a)[:k]
            out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(ranked)]
    return sorted(out)


def rows_of(seed, n, dim, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, spread) for x in c]
        rows.append((i, rows[0][1] if rows and rng.random() < 0.3 else v, 0))
    return rows


@pytest.mark.parametrize("seed,dim,parts", [(1, 8, 2), (2, 5, 3), (3, 6, 1)])
def test_matches_all_pairs(spark, seed, dim, parts):
    rows = rows_of(seed, 400, dim, 0.3) + [(900, None, 0), (901, [None] * dim, 0), (902, [float("nan")] * dim, 0), (903, [float("inf")] * dim, 0), (None, [1.0] * dim, 0), (7, [0.5] * dim, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit("x")).repartition(4)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, 10, parts=parts).collect()))
    assert got == brute(rows, 10, 20)


def test_negative_scores_ties_and_few_rows(spark):
    rows = [(i, [-1.0 if i % 2 else 1.0], 0) for i in range(9)] + [(20, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 2 == 0).collect()))
    padded = [(i, v or [0.0], 0) for i, v, _ in rows]
    assert got == brute(padded, 10, 2)


def test_empty_and_single(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0], 0)], SCHEMA), F.col("vec_id") == 0).collect() == []
