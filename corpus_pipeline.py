"""A training corpus from `documents`: filter, deduplicate, decontaminate, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.llm.common import read, small_side
from coeval.llm.decontam import benchmark_hits
from coeval.llm.decontam import row_key as leak_key
from coeval.llm.jaccard import jaccard_classes
from coeval.llm.lines import repeated_lines
from coeval.llm.mixing import mixed
from coeval.llm.quality import fit_quality, is_held_out, quality_scores
from coeval.session import RunFolder

#: Documents that score below this go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    It learns from labelled documents outside the held-out fold. Rows that
    repeat an id go together, by the best of their scores; texts with a null id
    are judged each by itself.
    """
    labels = read(spark, sf_dir, "labels").filter(~is_held_out("doc_id"))
    weights = fit_quality(docs.select("doc_id", "text"), labels)
    # An id's key has no space in it, so the two kinds are apart.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("doc_id", "text").cast("string")))
    scores = quality_scores(docs.select(key.alias("key"), "text"), weights, "key")
    poor = scores.groupBy("key").agg(F.max("score").alias("score")).filter(F.col("score") < LEAST_QUALITY)
    poor = RunFolder(spark).table("poor", poor.select(F.col("key").alias("poor_key")))
    return docs.join(small_side(poor), key == poor["poor_key"], "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later matching lines out of the texts.

    A document that had lines with words and has none left goes: all it said is
    said earlier. Texts without words stay. `n_chars` follows the text.
    """
    lines = repeated_lines(docs)
    left = lines.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of every group of linked documents. Null ids are not compared and stay."""
    classes = jaccard_classes(docs.select("doc_id", "text"))
    others = RunFolder(spark).table("others", classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("other_id")))
    return docs.join(small_side(others), docs["doc_id"] == others["other_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a window of a benchmark item."""
    hits = benchmark_hits(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"), nameless=True)
    leaks = RunFolder(spark).table("leaks", hits.select(F.col("key").alias("leak_key")))
    return docs.join(small_side(leaks), leak_key("doc_id", "text") == leaks["leak_key"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix repeats every document, with its size and its source's size and target.

    Returns every document of the stage's input with its columns, 0 copies and
    more; ``repeated`` makes the mix of it, at the end of ``run``.
    """
    return mixed(docs)


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: rows without copies left out, the others once for each ``copy`` 1, 2, ... ``copies``."""
    return docs.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: The classifier's fit cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: every stage in turn over `documents`, each written and read again, and the copies taken."""
    folder = RunFolder(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = folder.table(f"stage-{i}", stage(spark, docs, sf_dir))
    return repeated(docs)
