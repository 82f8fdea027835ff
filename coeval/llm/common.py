"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.session import RunFolder

#: Most rows a broadcast hint may stand on; a longer table is joined by a shuffle.
SMALL_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship_by_value(name: str) -> None:
    """Let Spark send a module's functions whole, so workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def drop_table(run: RunFolder, step: str) -> None:
    """Delete a step's table once nothing reads it any more."""
    context = run.spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{run.path}/{step}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a written table of at most ``rows`` rows; else no hint."""
    return F.broadcast(df) if df.count() <= rows else df


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send at most so many rows to a Python worker at a time: texts are wide.

    Both sides of the pipe hold a batch whole, and Spark counts it in rows.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > rows:
        spark.conf.set(name, rows)


def part_count(docs: DataFrame, text: str, megabytes: int) -> int:
    """Parts so that each stands for about ``megabytes`` of text, whatever the total."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // (megabytes << 20)))


def bites(batches, column: int, size: int = 2 << 20):
    """Arrow batches cut to pieces with about ``size`` bytes in a binary column, so arrays stay small."""
    import pyarrow.compute as pc

    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = held[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(held, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one, in place."""
    x ^= x >> np.uint64(32)
    x *= M3
    x ^= x >> np.uint64(29)
    x *= M1
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """Cache of 64-bit word hashes, emptied when it reaches its bound."""

    def __init__(self, bound: int = 150_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


ship_by_value(__name__)
