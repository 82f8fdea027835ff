import importlib

import pytest
from pyspark.sql import functions as F

from tests.llm import test_decontam, test_jaccard, test_lines, test_quality

pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with junk, copies, repeated lines and leaks, and odd rows; returns (folder, rows)."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = test_quality.corpus(250)
    clean = [t for (_, t, *_), (_, y) in zip(rows, labels) if y]
    items = [(i, " ".join(f"leak{i}x{j}" for j in range(14))) for i in range(3)]
    more = [clean[0], clean[1] + " tail", clean[2] + "\n" + clean[3], clean[4] + " " + items[1][1], "", None, "x " + clean[5]]
    rows += [(1000 + i, t) for i, t in enumerate(more)]
    rows = [(k, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, (k, t) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, items


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    folder, rows, labels, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(COLUMNS)
        kept.append(({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}))
        docs = out
    before, after = kept[0]
    junk = {k for k, y in labels if not y}
    assert len(junk - set(after)) >= 0.9 * len(junk) and not set(before) - set(after) - junk

    before, after = kept[1]
    want = test_lines.brute(list(before.items()))
    want = {k: t for k, (t, n, gone) in want.items() if not gone or t.split()}
    assert {k: r["text"] for k, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.values())

    before, after = kept[2]
    classes = test_jaccard.brute(list(before.items()))
    assert set(after) == {k for k, (_, root) in classes.items() if root == k}

    before, after = kept[3]
    hits = test_decontam.brute(list(before.items()), items)
    assert set(after) == {k for k, hit, _ in hits if not hit}

    before, after = kept[4]
    assert set(before) == set(after) and {0, 1, 2} >= {r["copies"] for r in after.values()}
    assert sum(r["copies"] * r["size"] for r in after.values()) == pytest.approx(1.5 * sum(r["size"] for r in after.values()), rel=0.2)


def test_run_and_empty_table(spark, tables, tmp_path):
    folder = tables[0]
    assert pipeline.run(spark, folder).count() > 100
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_null_ids_and_repeated_rows(spark, tables):
    folder = tables[0]
    text = " ".join(f"plain{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, None, None, None), (5, text, "en", "a", 1), (5, text, "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES[:1] + pipeline.STAGES[2:]:
        out = stage(spark, docs, folder)
        assert out.count() == 3
    assert {r["doc_id"] for r in pipeline.line_dedup(spark, docs.withColumn("z", F.lit(1)).drop("z"), folder).collect()} == {None}


def test_run_takes_the_copies(spark, tables):
    rows = pipeline.run(spark, tables[0]).collect()
    taken, largest, target, copies = {}, {}, {}, {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and r["copies"] > 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        target[r["source"]] = r["target"]
        copies.setdefault((r["doc_id"], r["text"]), []).append((r["copy"], r["copies"]))
    assert set(target) == {"a", "b", None}
    for source, words in taken.items():
        assert abs(words - target[source]) <= largest[source]
    for found in copies.values():
        assert sorted(c for c, _ in found) == list(range(1, found[0][1] + 1))
    assert {n for found in copies.values() for _, n in found} == {1, 2}


def test_null_ids_are_judged_each_by_itself(spark, tables):
    folder, rows, labels, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stays = {r["text"] for r in pipeline.quality(spark, docs, folder).filter("doc_id < 1000").collect()}
    junk = [t for (_, t, *_), (_, y) in zip(rows, labels) if not y and t not in stays][:5]
    good = [t for (_, t, *_), (_, y) in zip(rows, labels) if y and t in stays][:5]
    assert len(junk) == len(good) == 5
    # The labelled rows teach as before; their texts come once more without ids.
    more = spark.createDataFrame([(None, t, "en", "a", len(t)) for t in junk + good], docs.schema)
    left = pipeline.quality(spark, docs.unionByName(more), folder).filter("doc_id is null").collect()
    assert sorted(r["text"] for r in left) == sorted(good)
