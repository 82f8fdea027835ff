"""Token counts by a two-tier lookup of pre-tokens on the map side.

A pre-token is a stretch of text between ASCII white space. The tokenizer must
drop white space, so that a text's tokens are those of its pre-tokens. The
lengths (in tokens) of frequent pre-tokens are broadcast in one table whose size
a parameter bounds; any other is encoded once per worker and kept in a cache
with a bound of its own. No pre-token is shuffled: a first scan sends at most a
fixed number of the frequent ones from each task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.llm.common import bites, ship_by_value, short_batches

#: Pre-tokens broadcast, sent by a task, held while counting, cached by a worker; bytes above which none is kept.
FREQUENT, PER_TASK, COUNTED, CACHED, LONGEST = 32_768, 4_096, 250_000, 250_000, 64


def _heavy():
    """Most frequent pre-tokens of a partition; rare ones are forgotten when the table is full."""

    def run(batches):
        seen: Counter = Counter()
        for batch in bites(batches, 0):
            for text in batch.column(0):
                seen.update((text.as_py() or b"").split())
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = [(w, n) for w, n in seen.most_common(PER_TASK) if len(w) <= LONGEST]
        yield pa.record_batch({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    return run


def _encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(words: list[bytes]) -> list[int]:
        """Tokens of every pre-token: some are joined by line feeds and told apart by where tokens start."""
        out: list[int] = []
        at = 0
        while at < len(words):
            some, size = [], 0
            while at < len(words) and size < 1 << 15:
                some.append(words[at].decode("utf-8", "replace"))
                size += len(some[-1]) + 1
                at += 1
            ends = np.cumsum([len(w) + 1 for w in some])
            starts = [a for a, _ in tokenizer.encode("\n".join(some), add_special_tokens=False).offsets]
            out += np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(some)).tolist()
        return out

    return count


def _counter(path: str, table):
    """(id, bytes) to (id, tokens)."""

    def run(batches):
        encode = None
        frequent = table.value
        cache: dict[bytes, int] = {}
        for batch in bites(batches, 1):
            texts = [(x.as_py() or b"").split() for x in batch.column(1)]
            missing = list({w for words in texts for w in words if w not in frequent and w not in cache})
            once = {}
            if missing:
                encode = encode or _encoder(path)
                if len(cache) > CACHED:
                    cache.clear()
                    missing = list({w for words in texts for w in words if w not in frequent})
                once = dict(zip(missing, encode(missing)))
            local = {**once}
            totals = []
            for words in texts:
                total = 0
                for w in words:
                    n = frequent.get(w)
                    if n is None:
                        n = local.get(w)
                        if n is None:
                            n = cache[w]
                    total += n
                totals.append(total)
            cache.update((w, n) for w, n in once.items() if len(w) <= LONGEST)
            yield pa.record_batch({"row": batch.column(0), "n_tokens": pa.array(totals, pa.int64())})

    return run


def frequent_lengths(docs: DataFrame, text: str, path: str) -> dict[bytes, int]:
    """Token counts of at most FREQUENT pre-tokens, found over all texts."""
    counts = docs.select(F.col(text).cast("binary")).mapInArrow(_heavy(), "word binary, n bigint")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words = [bytes(r["word"]) for r in top]
    return dict(zip(words, _encoder(path)(words))) if words else {}


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes bigint, n_tokens bigint) of every row.

    ``path`` is a tokenizers file that every worker can open; its normaliser or
    pre-tokenizer must drop white space. Tokens are those of the library, with
    neither begin nor end; special strings in a text count as it counts them.

    Null and empty texts have no bytes and no tokens. Very long texts are
    counted whole. Repeated rows and ids are counted row by row; null ids are
    passed on. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    if not _drops_space(path):
        raise ValueError("the tokenizer keeps white space, so texts cannot be split at it")
    table = spark.sparkContext.broadcast(frequent_lengths(docs, text, path))
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.struct(F.col(id_column).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes")).alias("row"), F.col(text).cast("binary").alias("bytes"))
    counted = plain.mapInArrow(_counter(path, table), f"row struct<id:{kind},n_bytes:bigint>, n_tokens bigint")
    return counted.select(F.col("row.id").alias(id_column), F.col("row.n_bytes").alias("n_bytes"), "n_tokens")


def _drops_space(path: str) -> bool:
    count = _encoder(path)
    return count([b"a b", b"a", b" a\n\t b ", b"\r\n "]) == [2 * count([b"a"])[0], count([b"a"])[0], 2 * count([b"a"])[0], 0] and count([b"a"]) == count([b"b"])


ship_by_value(__name__)
