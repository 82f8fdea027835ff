"""Quality scores: logistic regression on hashed word n-grams, fitted by FTRL.

Tokens are runs of letters and digits and runs of other printing characters;
features are single tokens and neighbouring pairs, hashed to a fixed number of
slots. An n-gram that repeats its first token at its end shares a slot with all
such n-grams of its length, so that repetition is seen whatever is repeated.
Values are roots of frequencies. The fit sees at most a fixed
number of labelled rows, chosen and ordered by a hash of the id, and makes
follow-the-regularised-leader updates one row at a time, so weights stay sparse.
Scoring is a sparse dot product with the broadcast weights.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coeval.llm.common import M1, WordHashes, bites, scramble, ship_by_value, short_batches
from coeval.session import RunFolder

SLOTS = 1 << 18
#: Longest distance at which a repeated token counts as such.
REPEATS = 4
#: Most labelled rows that a fit uses, and passes over them.
SAMPLE_ROWS, PASSES = 12_000, 3
#: FTRL: learning rate, its smoothing, and the strength of both penalties.
ALPHA, BETA, LASSO, RIDGE = 0.5, 1.0, 0.02, 0.1

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20\x7f]+")


def features(text: bytes | None, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and values of a text's tokens and n-grams; slot 0 is the bias."""
    found = TOKEN.findall(text.lower()) if text else []
    if not found:
        return np.zeros(1, np.int32), np.ones(1)
    one = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    two = scramble(one[:-1] * M1 + one[1:])
    again = [np.full(int((one[:-d] == one[d:]).sum()), d, np.uint64) for d in range(1, REPEATS + 1)]
    slots, counts = np.unique(np.concatenate([one, two]) % np.uint64(SLOTS - 1 - REPEATS) + np.uint64(1 + REPEATS), return_counts=True)
    near, times = np.unique(np.concatenate(again), return_counts=True)
    slots = np.concatenate([[0], near, slots]).astype(np.int32)
    return slots, np.sqrt(np.concatenate([[len(one)], times, counts]) / len(one))


def _logit(weights: np.ndarray, slots: np.ndarray, values: np.ndarray) -> float:
    return float((weights[slots] * values).sum())


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _featurer():
    def run(batches):
        words = WordHashes()
        for batch in bites(batches, 2):
            rows = [features(x.as_py(), words) for x in batch.column(2)]
            slots, values = ([r[k].tobytes() for r in rows] for k in (0, 1))
            yield pa.record_batch({"id": batch.column(0), "label": batch.column(1), "slots": pa.array(slots, pa.binary()), "amounts": pa.array(values, pa.binary())})

    return run


def _fitter():
    """FTRL over the bounded sample, in order of a hash of the id."""

    def run(table: pa.Table) -> pa.Table:
        import xxhash

        ids, labels = table.column("id").to_pylist(), table.column("label").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (xxhash.xxh3_64_intdigest(str(ids[i])), ids[i]))
        rows = [(np.frombuffer(table.column("slots")[i].as_py(), np.int32), np.frombuffer(table.column("amounts")[i].as_py())) for i in order]
        targets = [labels[i] for i in order]
        z, n = np.zeros(SLOTS), np.zeros(SLOTS)
        solve = lambda z, n: np.where(np.abs(z) <= LASSO, 0.0, (np.sign(z) * LASSO - z) / ((BETA + np.sqrt(n)) / ALPHA + RIDGE))
        for _ in range(PASSES):
            for (slots, values), target in zip(rows, targets):
                weights = solve(z[slots], n[slots])
                slope = (_sigmoid((weights * values).sum()) - target) * values
                sigma = (np.sqrt(n[slots] + slope * slope) - np.sqrt(n[slots])) / ALPHA
                z[slots] += slope - sigma * weights
                n[slots] += slope * slope
        weights = solve(z, n)
        at = np.nonzero(weights)[0]
        return pa.table({"slot": pa.array(at, pa.int32()), "weight": pa.array(weights[at], pa.float64())})

    return run


def _scorer(shared):
    def run(batches):
        words, weights = WordHashes(), shared.value
        for batch in bites(batches, 1):
            scores = [_sigmoid(_logit(weights, *features(x.as_py(), words))) for x in batch.column(1)]
            yield pa.record_batch({"row": batch.column(0), "score": pa.array(scores, pa.float64())})

    return run


def is_held_out(id_column: str, folds: int = 5) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights of all slots, from at most SAMPLE_ROWS labelled rows.

    ``labels`` has the id and a 0/1 label. Ids with a null or with both labels
    are left out, and of rows that repeat an id one text is learned from. Without labelled rows all weights are 0, so every score is a half.
    """
    run = RunFolder(docs.sparkSession)
    short_batches(docs.sparkSession)
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.min(label).alias("low"), F.max(label).alias("high")).filter("low = high")
    picked = run.table("picked", known.orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE_ROWS).select(F.col(id_column).alias("id"), F.col("low").cast("double").alias("label")))
    # At most SAMPLE_ROWS ids are broadcast.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("bytes")).join(F.broadcast(picked), "id").select("id", "label", "bytes")
    # One text an id, chosen within tasks before they meet: an id may repeat any number of times.
    texts = texts.groupBy("id", "label").agg(F.min_by("bytes", F.struct(F.xxhash64("bytes"), F.octet_length("bytes"))).alias("bytes"))
    kind = picked.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(_featurer(), f"id {kind}, label double, slots binary, amounts binary")
    fitted = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fitter(), "slot int, weight double").collect()
    weights = np.zeros(SLOTS)
    weights[[r["slot"] for r in fitted]] = [r["weight"] for r in fitted]
    return weights


def quality_scores(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score double) of every row, 0 to 1, higher when label 1 is likelier.

    Null and empty texts have the score of no tokens. Very long texts are read
    whole. Repeated rows are scored one by one; null ids are passed on. An empty
    table gives no rows; other columns are not read.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.struct(F.col(id_column).alias("id")).alias("row"), F.col(text).cast("binary").alias("bytes"))
    scored = plain.mapInArrow(_scorer(shared), f"row struct<id:{kind}>, score double")
    return scored.select(F.col("row.id").alias(id_column), "score")


ship_by_value(__name__)
