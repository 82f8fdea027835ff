import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from coeval.llm.quality import fit_quality, is_held_out, quality_scores


def corpus(n=700):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        kind = rng.random()
        words = [word() for _ in range(rng.randint(20, 60))]
        if kind < 0.1:
            text = " | ".join(words)
        elif kind < 0.2:
            text = " ".join([words[0]] * 60)
        else:
            text = " ".join(words) + "."
        rows.append((i, text))
        labels.append((i, int(kind >= 0.2)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("slots", F.lit(1)).withColumn("score", F.lit("x"))
    known = spark.createDataFrame(labels + [(0, None), (None, 1), labels[1], (2, 1 - labels[2][1])], "doc_id bigint, quality int")
    weights = fit_quality(docs, known.filter(~is_held_out("doc_id")))
    assert (weights == fit_quality(docs.repartition(7), known.filter(~is_held_out("doc_id")))).all()
    scores = {r["doc_id"]: r["score"] for r in quality_scores(docs, weights).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and all(0 <= s <= 1 for s in scores.values())
    assert sum((scores[i] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)


def test_one_text_an_id_is_learned_from(spark):
    rows, labels = corpus(80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    many = docs.unionAll(docs.filter("doc_id < 3").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("again"))
    assert (fit_quality(many.repartition(5), known) == fit_quality(docs, known)).all()


def test_fold_matches_crc32(spark):
    got = spark.range(200).select("id", is_held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None), (1, ""), (None, " \n"), (2, "a" * 100_000), (3, "word " * 50_000), (3, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights = fit_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert not weights.any()
    assert [r["score"] for r in quality_scores(docs, weights).collect()] == [0.5] * len(rows)
    assert quality_scores(docs.limit(0), np.ones_like(weights)).collect() == []
