import hashlib
import random

import pytest

import coeval.llm.suffix as suffix
from coeval.llm.suffix import repeated_spans


def brute(rows, length):
    """{id: (spans, kept)} by counting every string."""
    seen = {}
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for k, b in texts:
        hit = [False] * (len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                hit[p : p + length] = [True] * length
        spans, kept = [], bytearray()
        for i in range(len(b)):
            if hit[i]:
                if i == 0 or not hit[i - 1]:
                    spans.append([i, i])
                spans[-1][1] = i + 1
            else:
                kept.append(b[i])
        out.append((k, tuple(map(tuple, spans)), hashlib.sha256(bytes(kept)).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, length):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).repartition(6)
    keyed = df.select("doc_id", suffix.row_key("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    cut = repeated_spans(df, length=length)
    rows = keyed.join(cut, keyed["k"] == cut["key"], "left").collect()
    return sorted(
        (
            (r["doc_id"], tuple((s["start"], s["stop"]) for s in r["spans"] or ()), hashlib.sha256(r["text"].encode() if r["kept"] is None else bytes(r["kept"])).hexdigest())
            for r in rows
        ),
        key=str,
    )


def corpus(seed, letters, docs, longest):
    rng = random.Random(seed)
    passage = "".join(rng.choice(letters) for _ in range(longest))
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        kind = rng.random()
        if kind < 0.3:
            a = rng.randrange(len(passage))
            text = text[: len(text) // 2] + passage[a : a + rng.randint(1, longest)] + text[len(text) // 2 :]
        elif kind < 0.6 and rows:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(letters)
            text = "".join(text)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("length,letters,longest", [(16, "ab", 60), (40, "abcdefgé", 300), (400, "abcdefghij klmnopqrstuvwxyzß", 3000)])
def test_matches_counting(spark, length, letters, longest):
    rows = corpus(length, letters, 40, longest)
    rows += [(90, None), (91, ""), (92, "a" * (3 * length)), (93, "ab" * length), (94, "x" * length), (None, rows[3][1]), (3, rows[3][1])]
    assert found(spark, rows, length) == brute(rows, length)


def test_segments_do_not_show(spark, monkeypatch):
    rows = corpus(7, "abcdefghijklmnop", 25, 4000)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    assert found(spark, rows, 100) == brute(rows, 100)


def test_empty_table_and_short_threshold(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeated_spans(empty).collect() == []
    with pytest.raises(ValueError):
        repeated_spans(empty, length=8)
