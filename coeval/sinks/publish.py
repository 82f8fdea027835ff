"""Bundles: Parquet tables plus one metadata file, published by a single rename.

A bundle is staged beside its destination and renamed only when every table and
the metadata are in place. An existing destination is never touched.
"""

from __future__ import annotations

import hashlib
import json
import platform
import uuid
from collections.abc import Mapping

import pyspark
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "metadata.json"
DIGEST_TAG = "coeval-rows-1"


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _filesystem(spark, path).exists(_path(spark, path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole; an existing one is an error."""
    stream = _filesystem(spark, path).create(_path(spark, path), False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    stream = _filesystem(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, destination: str) -> None:
    """Rename that fails when the destination exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    target = _filesystem(spark, destination).makeQualified(_path(spark, destination))
    origin = _filesystem(spark, source).makeQualified(_path(spark, source))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(origin, target, options)


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order or partitioning.

    Every row hashes to 240 bits taken as four integers; the integers are
    summed, so rows combine in any order and repeats count.
    """
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    pieces = [
        F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}")
        for i in range(4)
    ]
    total = df.select(*names).agg(F.count("*").alias("rows"), *pieces).first()
    parts = [DIGEST_TAG, *names, str(total["rows"]), *[str(total[f"p{i}"]) for i in range(4)]]
    return hashlib.sha256("\0".join(parts).encode("utf-8")).hexdigest()


def software() -> dict[str, str]:
    from coeval import __version__

    return {"coeval": __version__, "spark": pyspark.__version__, "python": platform.python_version()}


def publish(
    spark: SparkSession,
    destination: str,
    schema_version: str,
    tables: Mapping[str, DataFrame],
    metadata: Mapping[str, object],
    partition_by: Mapping[str, list[str]] | None = None,
) -> None:
    """Write all tables and metadata, then claim the destination."""
    destination = destination.rstrip("/")
    if exists(spark, destination):
        raise FileExistsError(f"output already exists: {destination}")
    staging = f"{destination}.staging-{uuid.uuid4().hex}"
    described: dict[str, object] = {}
    for name, frame in tables.items():
        writer = frame.write.mode("errorifexists")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{staging}/{name}")
        written = spark.read.schema(frame.schema).parquet(f"{staging}/{name}")
        described[name] = {"schema": json.loads(frame.schema.json()), "digest": table_digest(written)}
    payload = {
        **metadata,
        "schema_version": schema_version,
        "complete": True,
        "tables": described,
        "software": software(),
    }
    write_text(spark, f"{staging}/{METADATA}", json.dumps(payload, indent=2, sort_keys=True))
    rename_new(spark, staging, destination)
