"""Open published bundles: known version, complete, explicit schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from coeval.sinks.publish import METADATA, exists, read_text, table_digest

INTERVAL_STORE = "coeval-interval-store-1"
DENSE_STORE = "coeval-dense-store-1"
TARGET = "coeval-target-1"
CONTROLS = "coeval-controls-1"
REPLICATES = "coeval-replicate-matches-1"
SPECTRA = "coeval-phi-sfs-1"
DISTRIBUTION = "coeval-distribution-1"
KNOWN = (INTERVAL_STORE, DENSE_STORE, TARGET, CONTROLS, REPLICATES, SPECTRA, DISTRIBUTION)


@dataclass
class Bundle:
    path: str
    metadata: dict
    spark: SparkSession

    @property
    def version(self) -> str:
        return self.metadata["schema_version"]

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromJson(self.metadata["tables"][name]["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def digest(self, name: str) -> str:
        return self.metadata["tables"][name]["digest"]

    def verify(self) -> None:
        """Deep check: every table still has the digest it was published with."""
        for name in self.metadata["tables"]:
            if table_digest(self.table(name)) != self.digest(name):
                raise ValueError(f"{self.path}: table {name} does not match its digest")


def open_bundle(spark: SparkSession, path: str, *versions: str, deep: bool = False) -> Bundle:
    """Open a bundle of one of ``versions``; any known version when none is given."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/{METADATA}"):
        raise FileNotFoundError(f"{path} is not a published bundle")
    metadata = json.loads(read_text(spark, f"{path}/{METADATA}"))
    version = metadata.get("schema_version")
    if version not in (versions or KNOWN):
        raise ValueError(f"{path}: unsupported schema version {version!r}")
    if metadata.get("complete") is not True:
        raise ValueError(f"{path}: bundle is not complete")
    bundle = Bundle(path, metadata, spark)
    if deep:
        bundle.verify()
    return bundle


def is_complete(spark: SparkSession, path: str, version: str, step: str | None = None) -> bool:
    """Whether a finished bundle of this version, made by this step, is already there.

    Nothing there means no; anything else there is an error, never a reason to
    overwrite. With a step's key the bundle's tables are counted and digested anew.
    """
    if not exists(spark, path):
        return False
    bundle = open_bundle(spark, path, version, deep=step is not None)
    if step is not None and bundle.metadata.get("step") != step:
        raise ValueError(f"{path}: made from other inputs, settings or software")
    return True


def content_identity(bundle: Bundle) -> dict:
    """What a bundle holds: its version and its tables' digests."""
    return {"version": bundle.version, "tables": {name: bundle.digest(name) for name in sorted(bundle.metadata["tables"])}}


def require_same_source(store: Bundle, *derived: Bundle) -> None:
    """Every derived bundle must name this store's catalog and interval digests."""
    identity = source_identity(store)
    for bundle in derived:
        if bundle.metadata.get("source") != identity:
            raise ValueError(f"{bundle.path} was derived from a different store")


def source_identity(store: Bundle) -> dict[str, str]:
    facts = "intervals" if store.version == INTERVAL_STORE else "codes"
    return {"version": store.version, "sites": store.digest("sites"), facts: store.digest(facts)}
