"""VCF text to polarised (k derived, n callable) counts."""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.functions.genotype import (
    HETEROZYGOUS,
    INVALID,
    NON_BIALLELIC,
    decode_genotype,
    info_value,
    sample_genotype,
)

GZIP_MAGIC = b"\x1f\x8b"
#: Fixed value: the empty block that ends a block-gzipped file.
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
# Fields before the samples once CHROM and POS are cut off.
FIXED_FIELDS = 7
# Requests up to so many rows are sent to every task.
SMALL_REQUEST = 1_000_000


MALFORMED = "malformed record"


class DamagedFile(ValueError):
    """A compressed file that cannot be read to its end."""


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _ranges(spark: SparkSession, path: str, size: int, split_bytes: int) -> DataFrame:
    count = max(1, -(-size // split_bytes))
    return spark.range(0, count, 1, count).select(
        F.col("id"),
        F.lit(path).alias("path"),
        (F.col("id") * split_bytes).alias("first"),
        F.least(F.lit(size), (F.col("id") + 1) * split_bytes).alias("last"),
    )


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """VCF lines as (value); the file's first bytes tell how they are stored.

    Plain text and plain gzip use the built-in reader, which wants ``.gz`` for
    the latter and reads it in one task. Block-gzipped files, whatever their
    name, are cut into byte ranges read in parallel: blocks are independent, so
    every task starts at the first block of its range. A block that is damaged,
    cut short or missing at the end raises ``DamagedFile``.
    """
    with _opened(path) as handle:
        size = handle.size()
        head = handle.read(min(size, 1 << 16))
        handle.seek(max(0, size - len(LAST_BLOCK)))
        tail = handle.read(len(LAST_BLOCK))
    if head[:2] != GZIP_MAGIC:
        if path.lower().endswith((".gz", ".bgz", ".bgzf")) and size:
            raise DamagedFile(f"{path} is named as compressed but is not")
        return spark.read.text(path)
    if _block_size(head) is None:
        if not path.lower().endswith(".gz"):
            raise DamagedFile(f"{path} is plain gzip and must be named .gz")
        return spark.read.text(path)
    if tail != LAST_BLOCK:
        raise DamagedFile(f"{path} lacks its last block")
    return _ranges(spark, path, size, split_bytes).select("path", "first", "last").mapInPandas(_block_lines, schema="value STRING")


def _block_size(header: bytes) -> int | None:
    """Size of the block this header opens, or None when it opens none."""
    if len(header) < 12 or header[:3] != b"\x1f\x8b\x08" or not header[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", header, 10)[0]
    at = 12
    while at + 4 <= min(end, len(header)):
        length = struct.unpack_from("<H", header, at + 2)[0]
        if header[at : at + 2] == b"BC" and length == 2 and at + 6 <= len(header):
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + length
    return None


def _block_at(handle, start: int, size: int) -> tuple[int, bytes]:
    """(next start, text) of the block at ``start``, checked against its own sums."""
    handle.seek(start)
    stored = handle.read(1 << 16)
    length = _block_size(stored)
    if length is None or start + length > size:
        raise DamagedFile(f"no whole block at byte {start}")
    try:
        return start + length, zlib.decompress(stored[:length], 31)
    except zlib.error as error:
        raise DamagedFile(f"damaged block at byte {start}: {error}") from error


def _first_block(handle, offset: int, size: int) -> int | None:
    """Start of the first readable block at or after ``offset``.

    A damaged block is passed over here and raised by the range before, which
    reads one block past its own end.
    """
    while offset < size:
        handle.seek(offset)
        window = handle.read(CHUNK_BYTES)
        found = window.find(GZIP_MAGIC)
        while found >= 0:
            try:
                _block_at(handle, offset + found, size)
                return offset + found
            except DamagedFile:
                found = window.find(GZIP_MAGIC, found + 1)
        if offset + len(window) >= size:
            return None
        offset += len(window) - 1
    return None


def _block_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole lines of each byte range.

    A range leaves the text up to the first line break of its first block to
    the range before, and reads past its own end up to one line break. It reads
    the block there in any case, so every block is checked by the range that
    holds it or by the one before.
    """
    for batch in batches:
        for path, first, last in batch[["path", "first", "last"]].itertuples(index=False):
            with _opened(path) as handle:
                size = handle.size()
                start = _first_block(handle, int(first), size) if first else 0
                held, skipping = b"", first > 0
                while start is not None and start < size:
                    beyond = start >= last
                    start, data = _block_at(handle, start, size)
                    if beyond:
                        cut = data.find(b"\n") + 1
                        if not skipping:
                            held += data[:cut] if cut else data
                        if skipping or cut:
                            break
                        continue
                    if skipping:
                        cut = data.find(b"\n") + 1
                        if not cut:
                            continue
                        data, skipping = data[cut:], False
                    held += data
                    whole = held.rfind(b"\n") + 1
                    if whole:
                        yield pd.DataFrame({"value": held[:whole].decode("utf-8").split("\n")[:-1]})
                        held = held[whole:]
                if held:
                    yield pd.DataFrame({"value": [held.decode("utf-8").removesuffix("\n")]})


def site_counts(
    lines: DataFrame,
    requested: DataFrame,
    ancestral: str = "ref",
    ancestral_key: str = "AA",
    heterozygous: str = "error",
) -> DataFrame:
    """(chrom, pos, k, n, problem) of the requested records.

    Only CHROM and POS are cut from a record until it is known to be wanted;
    the sample columns of the rest are never split. Records without them, asked
    for or not, come back as malformed, so one scan finds every problem.
    """
    if ancestral not in ("ref", "info"):
        raise ValueError("ancestral must be 'ref' or 'info'")
    head = F.split("value", "\t", 3)
    pos = F.try_element_at(head, F.lit(2)).try_cast("bigint")
    keyed = lines.where(~F.col("value").startswith("#")).select(
        head[0].alias("chrom"),
        pos.alias("pos"),
        F.try_element_at(head, F.lit(3)).alias("rest"),
        ((F.size(head) < 3) | pos.isNull()).alias("malformed"),
    )
    asked = requested.select("chrom", "pos").distinct().withColumn("_asked", F.lit(True))
    wanted_only = F.coalesce("_asked", F.lit(False)) | F.col("malformed")
    if asked.limit(SMALL_REQUEST + 1).count() <= SMALL_REQUEST:
        # Records are dropped where they are read.
        kept = keyed.join(F.broadcast(asked), ["chrom", "pos"], "left").where(wanted_only)
        return _parsed_counts(kept, ancestral, ancestral_key, heterozygous)
    # Too many to send along: every record is counted first, so that only numbers are shuffled.
    counts = _parsed_counts(keyed, ancestral, ancestral_key, heterozygous)
    counts = counts.withColumn("malformed", F.coalesce(F.col("problem") == MALFORMED, F.lit(False)))
    return counts.join(asked, ["chrom", "pos"], "left").where(wanted_only).drop("malformed", "_asked")


def _parsed_counts(wanted: DataFrame, ancestral: str, ancestral_key: str, heterozygous: str) -> DataFrame:
    """(chrom, pos, k, n, problem) of records cut into (chrom, pos, rest, malformed)."""
    fields = wanted.withColumn("f", F.split("rest", "\t", FIXED_FIELDS + 1))
    field = lambda i: F.try_element_at("f", F.lit(i))
    parsed = fields.select(
        "chrom",
        "pos",
        "malformed",
        field(2).alias("ref"),
        field(3).alias("alt"),
        field(6).alias("info"),
        (F.array_position(F.split(field(7), ":"), "GT") - 1).cast("int").alias("gt_index"),
        field(FIXED_FIELDS + 1).alias("samples"),
        (F.size("f") <= FIXED_FIELDS).alias("short"),
    )
    counted = _count_plain_calls(parsed)
    decode = lambda s: decode_genotype(sample_genotype(s, F.col("gt_index")), heterozygous)
    origin = F.col("ref") if ancestral == "ref" else info_value(F.col("info"), ancestral_key)
    called = counted.withColumn("origin", origin).withColumn(
        "alleles",
        F.when((F.col("gt_index") >= 0) & ~F.col("plain"), F.transform(F.split("samples", "\t"), decode)),
    )
    n = F.when(F.col("plain"), F.col("n_ref") + F.col("n_alt")).otherwise(
        F.size(F.filter("alleles", lambda a: a >= 0))
    )
    alt = F.when(F.col("plain"), F.col("n_alt")).otherwise(F.size(F.filter("alleles", lambda a: a == 1)))
    k = F.when(F.col("origin") == F.col("ref"), alt).otherwise(n - alt)
    return called.select(
        "chrom", "pos", k.cast("bigint").alias("k"), n.cast("bigint").alias("n"),
        _record_problem(ancestral).alias("problem"),
    )


def _count_plain_calls(parsed: DataFrame) -> DataFrame:
    """Count the usual calls of a record as text, without splitting its samples.

    ``plain`` tells that every sample was one of the usual spellings of 0, 1 or
    missing; only other records go through the call-by-call decoder.
    """
    text = F.concat(F.lit("\t"), F.col("samples"))
    skipped = F.repeat(F.lit("[^:\t]*:"), F.greatest(F.col("gt_index"), F.lit(0)))
    count = lambda call: F.regexp_count(
        text, F.concat(F.lit("\t"), skipped, F.lit(f"(?:{call})(?=[:\t]|$)"))
    )
    total = F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit("")))
    tallied = parsed.withColumns(
        {
            "n_ref": count(r"0(?:[/|]0)?"),
            "n_alt": count(r"1(?:[/|]1)?"),
            "n_gap": count(r"\.(?:[/|]\.)?"),
        }
    )
    plain = (F.col("gt_index") >= 0) & (F.col("n_ref") + F.col("n_alt") + F.col("n_gap") == total)
    return tallied.withColumn("plain", F.coalesce(plain, F.lit(False)))


def _record_problem(ancestral: str) -> Column:
    has = lambda code: F.coalesce(F.exists("alleles", lambda a: a == code), F.lit(False))
    problem = F.when(F.col("malformed"), F.lit(MALFORMED))
    problem = problem.when(F.col("short"), F.lit("no samples or FORMAT")).when(
        F.contains(F.col("alt"), F.lit(",")), F.lit("multiallelic record")
    )
    if ancestral == "info":
        problem = problem.when(
            F.col("origin").isNull() | F.contains(F.col("origin"), F.lit(",")),
            F.lit("missing or ambiguous ancestral allele"),
        )
    return (
        problem.when(
            (F.col("origin") != F.col("ref")) & (F.col("origin") != F.col("alt")),
            F.lit("ancestral allele is neither REF nor ALT"),
        )
        .when(F.col("gt_index") < 0, F.lit("record lacks GT"))
        .when(has(INVALID), F.lit("invalid genotype"))
        .when(has(NON_BIALLELIC), F.lit("non-biallelic genotype"))
        .when(has(HETEROZYGOUS), F.lit("heterozygous genotype"))
    )


def malformed_records(lines: DataFrame) -> DataFrame:
    """Records without three columns or with a non-integer POS."""
    head = F.split("value", "\t", 3)
    return lines.where(~F.col("value").startswith("#")).where(
        (F.size(head) < 3) | F.try_element_at(head, F.lit(2)).try_cast("bigint").isNull()
    )


def completeness_problems(requested: DataFrame, counts: DataFrame) -> DataFrame:
    """Requested coordinates that are absent from the file or appear twice."""
    found = counts.groupBy("chrom", "pos").agg(F.count("*").alias("records"))
    joined = requested.select("chrom", "pos").distinct().join(found, ["chrom", "pos"], "left")
    problem = F.when(F.col("records").isNull(), F.lit("absent")).when(
        F.col("records") > 1, F.lit("duplicate record")
    )
    return joined.select("chrom", "pos", problem.alias("problem")).where("problem IS NOT NULL")


def file_digest(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Digest of the file's stored bytes: SHA-256 of its ranges' SHA-256 digests, in order.

    Ranges are read by the tasks that digest them, from any store they can open.
    """
    with _opened(path) as handle:
        size = handle.size()
    parts = _ranges(spark, path, size, split_bytes).mapInPandas(_range_digests, schema="id BIGINT, digest BINARY").collect()
    whole = hashlib.sha256(b"".join(bytes(r["digest"]) for r in sorted(parts, key=lambda r: r["id"])))
    return f"sha256-of-{split_bytes}:{whole.hexdigest()}"


def _range_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for index, path, first, last in batch[["id", "path", "first", "last"]].itertuples(index=False):
            digest = hashlib.sha256()
            with _opened(path) as handle:
                handle.seek(int(first))
                left = int(last) - int(first)
                while left > 0 and (chunk := handle.read(min(left, CHUNK_BYTES))):
                    digest.update(chunk)
                    left -= len(chunk)
            yield pd.DataFrame({"id": [index], "digest": [digest.digest()]})


# Workers get the readers themselves, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
