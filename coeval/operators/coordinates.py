"""Native (chromosome, 1-based position) and global coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.schema import CHROMOSOMES
from coeval.session import broadcast_within


# Most chromosomes sent to every task; a longer table is joined by a shuffle.
LISTED_CHROMOSOMES = 100_000


@dataclass(frozen=True)
class Chromosome:
    chrom: str
    offset: int
    length: int


def validate_chromosomes(
    table: list[Chromosome], sequence_length: float | None = None, disjoint: bool = True
) -> None:
    """Unique names, positive lengths, increasing offsets, optional disjointness."""
    if not table:
        raise ValueError("chromosome table is empty")
    if len({c.chrom for c in table}) != len(table):
        raise ValueError("chromosome names are not unique")
    if any(c.length <= 0 or c.offset < 0 for c in table):
        raise ValueError("chromosome offsets must be nonnegative and lengths positive")
    for before, after in zip(table, table[1:]):
        if after.offset <= before.offset:
            raise ValueError("chromosome offsets must increase")
        if disjoint and before.offset + before.length > after.offset:
            raise ValueError(f"chromosomes {before.chrom} and {after.chrom} overlap")
    if sequence_length is not None and any(
        c.offset + c.length > sequence_length for c in table
    ):
        raise ValueError("chromosome table exceeds the sequence length")


def chromosome_frame(spark: SparkSession, table: list[Chromosome]) -> DataFrame:
    return spark.createDataFrame(
        [(c.chrom, c.offset, c.length) for c in table], schema=CHROMOSOMES
    )


def native_to_global(requests: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Add ``position`` and a ``problem`` column to (chrom, native) requests.

    The chromosome table is a broadcast side as long as it is within
    ``LISTED_CHROMOSOMES`` rows, which is checked here.
    """
    table = broadcast_within(chromosomes, LISTED_CHROMOSOMES)
    joined = requests.join(table, "chrom", "left")
    problem = F.when(F.col("offset").isNull(), F.lit("unknown chromosome")).when(
        ~F.col("native").between(F.lit(1), F.col("length")), F.lit("position out of range")
    )
    position = F.when(problem.isNull(), F.col("offset") + F.col("native"))
    return joined.withColumns({"position": position, "problem": problem}).drop("offset", "length")


def interval_levels(intervals: DataFrame) -> DataFrame:
    """(level, bin, chrom, offset, length): intervals (offset, offset + length] under the bins they touch at their own level.

    A level's bins are the power of two next above its intervals' lengths wide,
    so an interval touches two bins at most, however unequal lengths are.
    """
    level = F.when(F.col("length") <= 1, 0).otherwise(F.length(F.bin(F.col("length") - 1)))
    width = F.expr("shiftleft(1L, level)")
    bins = F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("length")) / width))
    return intervals.withColumn("level", level.cast("int")).select("level", F.explode(bins).alias("bin"), "chrom", "offset", "length")


def global_to_native(sites: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Add ``chrom`` and ``native`` to global positions; NULL in a gap.

    A range lookup turned into equi joins: a position looks up one bin at each
    level that occurs, of which there are no more than bits in a length. The
    driver lists the levels. Chromosomes are disjoint, so one level at most answers.
    """
    listed = interval_levels(chromosomes)
    levels = sorted(r["level"] for r in listed.select("level").distinct().collect())
    found = sites.withColumns({"chrom": F.lit(None).cast("string"), "_from": F.lit(None).cast("bigint")})
    for level in levels:
        own = listed.where(F.col("level") == level).select(F.col("bin").alias("_bin"), F.col("chrom").alias("_chrom"), F.col("offset").alias("_offset"), F.col("length").alias("_length"))
        at = F.floor(F.col("position") / F.lit(1 << level)) == F.col("_bin")
        inside = (F.col("position") > F.col("_offset")) & (F.col("position") <= F.col("_offset") + F.col("_length"))
        met = found.join(broadcast_within(own, 2 * LISTED_CHROMOSOMES), at & inside, "left")
        found = met.withColumns({"chrom": F.coalesce("chrom", "_chrom"), "_from": F.coalesce("_from", "_offset")}).drop("_bin", "_chrom", "_offset", "_length")
    return found.withColumn("native", F.col("position") - F.col("_from")).drop("_from")
