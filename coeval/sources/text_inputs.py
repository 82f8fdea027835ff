"""Position lists, chromosome offsets and run manifests."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.operators.coordinates import Chromosome, validate_chromosomes
from coeval.sinks.publish import read_text

# Manifest columns and the pattern of a run label.
MANIFEST_COLUMNS = ("label", "positions", "target", "output", "seed")
LABEL_PATTERN = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def tokens(line: Column) -> Column:
    """Whitespace tokens before any ``#``; an empty array for a blank line."""
    bare = F.trim(F.regexp_replace(F.substring_index(line, "#", 1), r"\s+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def native_positions(lines: DataFrame) -> DataFrame:
    """(chrom, native, problem) of every non-blank line of a position list."""
    parts = lines.select(tokens(F.col("value")).alias("t")).where(F.size("t") > 0)
    native = F.try_element_at("t", F.lit(2)).try_cast("bigint")
    problem = (
        F.when(F.size("t") != 2, F.lit("expected two columns"))
        .when(native.isNull(), F.lit("position is not an integer"))
        .when(native < 1, F.lit("position below 1"))
    )
    return parts.select(F.col("t")[0].alias("chrom"), native.alias("native"), problem.alias("problem"))


def load_native_positions(spark: SparkSession, path: str) -> DataFrame:
    """Validated (chrom, native) list: two columns, 1-based, unique, not empty."""
    parsed = native_positions(spark.read.text(path))
    bad = parsed.where("problem IS NOT NULL").limit(10).collect()
    if bad:
        raise ValueError(f"{path}: {[r.problem for r in bad]}")
    repeated = parsed.groupBy("chrom", "native").count().where("count > 1").limit(10).collect()
    if repeated:
        raise ValueError(f"{path}: repeated positions {[(r.chrom, r.native) for r in repeated]}")
    listed = parsed.select("chrom", "native")
    if listed.isEmpty():
        raise ValueError(f"{path}: no positions")
    return listed


def numeric_positions(lines: DataFrame) -> DataFrame:
    """First token of each non-blank line as a number; later columns are ignored."""
    parts = lines.select(tokens(F.col("value")).alias("t")).where(F.size("t") > 0)
    return parts.select(F.col("t")[0].try_cast("double").alias("position"))


def load_numeric_positions(spark: SparkSession, path: str | None, listed: list[float] | None = None) -> DataFrame:
    """Distinct finite positions of a list, of the command line, or of both; anything else in them is an error."""
    parts = [spark.createDataFrame([(str(x),) for x in listed], "value STRING")] if listed else []
    if path:
        parts.append(spark.read.text(path))
    if not parts:
        raise ValueError("no positions are given")
    found = numeric_positions(reduce(DataFrame.unionAll, parts))
    wrong = F.col("position").isNull() | F.isnan("position") | (F.abs("position") == float("inf"))
    bad = found.where(wrong).count()
    if bad:
        raise ValueError(f"{path or 'positions'}: {bad} values are not finite numbers")
    return found.distinct()


def parse_offsets(lines: list[str]) -> list[Chromosome]:
    """``chrom length`` (cumulative) or ``chrom offset length`` lines, not mixed."""
    rows = [line.split("#", 1)[0].split() for line in lines]
    rows = [r for r in rows if r]
    if not rows:
        raise ValueError("chromosome offsets file is empty")
    widths = {len(r) for r in rows}
    if widths not in ({2}, {3}):
        raise ValueError("chromosome lines must all have two or all have three columns")
    table, running = [], 0
    for row in rows:
        try:
            numbers = [int(value) for value in row[1:]]
        except ValueError as error:
            raise ValueError(f"chromosome {row[0]}: values must be integers") from error
        offset = running if len(numbers) == 1 else numbers[0]
        table.append(Chromosome(row[0], offset, numbers[-1]))
        running += numbers[-1]
    validate_chromosomes(table)
    return table


def load_offsets(spark: SparkSession, path: str) -> list[Chromosome]:
    return parse_offsets(read_text(spark, path).splitlines())


def manifest_problems(table: DataFrame) -> DataFrame:
    """(problem, value) of every cell of a manifest that breaks a rule, and of every value that must not repeat."""
    cell = {c: F.coalesce(F.col(c), F.lit("")) for c in MANIFEST_COLUMNS}
    broken = {
        "malformed label": (cell["label"], ~cell["label"].rlike(f"^(?:{LABEL_PATTERN})$")),
        "seed that is no integer": (cell["seed"], F.trim(cell["seed"]).try_cast("decimal(38,0)").isNull() | ~cell["seed"].rlike(r"^\s*[+-]?[0-9]+\s*$")),
        **{f"empty {c} path": (cell["label"], F.trim(cell[c]) == "") for c in ("positions", "target", "output")},
    }
    cells = F.inline(F.array(*[F.struct(F.lit(name).alias("problem"), value.alias("value"), test.alias("wrong")) for name, (value, test) in broken.items()]))
    found = [table.select(cells).where("wrong").select("problem", "value")]
    for c in ("label", "target", "output"):
        found.append(table.groupBy(cell[c].alias("value")).count().where("count > 1").select(F.lit(f"repeated {c}").alias("problem"), "value"))
    return reduce(DataFrame.unionAll, found)


def load_manifest(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """Runs of a tab-separated manifest, in its order. The driver lists runs, as it starts every one of them."""
    table = spark.read.csv(path, sep="\t", header=True)
    lacking = [c for c in MANIFEST_COLUMNS if c not in table.columns]
    if lacking:
        raise ValueError(f"{path}: no column {lacking}")
    problems = manifest_problems(table).limit(10).collect()
    if problems:
        raise ValueError(f"{path}: {[(r['problem'], r['value']) for r in problems]}")
    runs = [r.asDict() for r in table.select(*MANIFEST_COLUMNS).collect()]
    if not runs:
        raise ValueError(f"{path}: no runs")
    return runs


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Sorted matches per pattern on any file system Spark knows, first mention kept; no match is an error.

    The place in the list is the draw number.
    """
    found: dict[str, None] = {}
    context = spark.sparkContext
    for pattern in patterns:
        path = context._jvm.org.apache.hadoop.fs.Path(pattern)
        statuses = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
        matches = sorted(s.getPath().toString() for s in statuses)
        if not matches:
            raise ValueError(f"no files match {pattern!r}")
        found.update(dict.fromkeys(matches))
    return list(found)


def listing_digest(spark: SparkSession, folders: list[str]) -> str:
    """Digest of the paths, lengths and times of change of all files below the folders."""
    context = spark.sparkContext
    rows = []
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(rows)).encode("utf-8")).hexdigest()
