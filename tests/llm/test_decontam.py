import random

import pytest
from pyspark.sql import functions as F

import coeval.llm.decontam as decontam
from coeval.llm.decontam import benchmark_hits, row_key


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10):
    wins = []
    for key, text in items:
        w = words(text)
        if key is not None and w:
            k = min(window, len(w))
            wins += [(str(key), tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    out = set()
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(name)
        out.add((key, frozenset(hit), tuple(sorted(found))))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit("x")).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("k", F.lit("y"))
    hits = benchmark_hits(d, i)
    rows = d.select("doc_id", row_key("doc_id", "text").alias("kk")).join(hits, F.col("kk") == hits["key"], "left").collect()
    return {(r["doc_id"], frozenset(p for s in r["spans"] or () for p in range(s["start"], s["stop"])), tuple(r["items"] or ())) for r in rows}


@pytest.mark.parametrize("seed,vocab", [(1, 3000), (2, 3)])
def test_matches_brute_force(spark, seed, vocab):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocab)]
    items = [(i, ", ".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(100, None), (101, " ?! "), (None, "w1 w2"), (3, items[3][1]), (102, "é Ä"), (103, "one"), (104, "a b c d e f g h i j k")]
    docs = []
    for i in range(50):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            leak = words(rng.choice(items)[1])
            a = rng.randrange(len(leak) + 1)
            text[len(text) // 2 : len(text) // 2] = leak[a:] if rng.random() < 0.5 else leak
        docs.append((i, " - ".join(text)))
    docs += [(200, None), (201, ""), (202, "ONE"), (203, "é Ä é ä"), (204, "x" * 50), (None, items[5][1]), (5, docs[5][1]), (205, "A b C d e f g h i j k " * 3)]
    assert found(spark, docs, items) == brute(docs, items)


def test_greek_capitals_beside_punctuation(spark):
    item = "ΑΒΓ ΟΔΟΣ.ΝΕΑ ένα two three four five six seven eight nine ten"
    items = [(1, item), (2, "ΟΔΟΣ-ΟΔΟΣ Σ.Σ ς"), (3, "İΣ K.Σa")]
    docs = [(1, item), (2, item.replace(".", " ").lower()), (3, "x ΟΔΟΣ ΟΔΟΣ.Σ,Σ ς"), (4, "İΣ K Σa ΟΔΟς-ΟΔΟΣ Σ.Σ ς"), (5, "ΑΒΓ, " * 5)]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert sum(bool(hit) for _, hit, _ in got) == 4


def test_blocks_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 7)
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 20)))) for i in range(8)]
    docs = [(i, " ".join(items[i % 8][1].split()[i % 3 :] + ["z"] + items[(i + 1) % 8][1].split())) for i in range(20)]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert benchmark_hits(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert benchmark_hits(docs, items.limit(0)).collect() == []


def test_items_without_an_id_count_but_have_no_name(spark, tmp_path):
    from coeval.llm.queries import QUERIES

    lone, both = (" ".join(f"{c}{i}" for i in range(12)) for c in "nm")
    spark.createDataFrame([(None, lone), (None, both), (7, both)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"a {lone} b"), (2, both), (3, "clean words"), (4, f"{lone} {both}")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in QUERIES["op9_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    # As the query's SQL counts them: items without an id are one more item.
    assert got == {1: (12, 1, True), 2: (12, 2, True), 3: (0, 0, False), 4: (24, 2, True)}
    hits = benchmark_hits(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), nameless=True)
    assert sorted(tuple(r["items"]) for r in hits.collect()) == [(), ("7",), ("7",)]
