"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column expression slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "coeval",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session with the defaults every operator here assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names, so that a
    lost executor never takes a table with it. Only a local master may fall
    back to a folder of its own.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="coeval-")
    context.setCheckpointDir(folder)
    return folder


_SCHEMAS: dict[str, StructType] = {}


class RunFolder:
    """Written tables of one run, named by step.

    A step's table is written once and read back, which cuts lineage and
    survives the loss of any executor. Parquet rather than ``checkpoint()``
    keeps size statistics, so a broadcast side is still chosen by measured
    bytes. Every random draw is a counter, so a resumed run that finds a step
    already written continues exactly where the first run stopped.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        identity: dict | None = None,
        resume: bool = False,
    ) -> None:
        self.spark = spark
        self.resume = resume
        self.path = (path or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}").rstrip("/")
        if path is None:
            return
        text = json.dumps(identity or {}, sort_keys=True)
        marker = f"{self.path}/identity"
        if not self._exists(marker):
            if self._exists(self.path):
                raise FileExistsError(f"{self.path} exists and is not a run folder")
            spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(marker)
            return
        if not resume:
            raise FileExistsError(f"run folder already exists: {self.path}")
        if spark.read.text(marker).first()["value"] != text:
            raise ValueError("run folder belongs to a different run")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def table(self, step: str, df: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        """Write ``df`` as the step's table, unless this run already has it.

        A callable is built only when needed; the schema of a table written or
        seen in this process is remembered, so reading back infers nothing.
        """
        path = f"{self.path}/{step}"
        schema = _SCHEMAS.get(path)
        if schema is None or not self.resume:
            frame = df() if callable(df) else df
            schema = frame.schema
            if not (self.resume and self._exists(f"{path}/_SUCCESS")):
                mode = "overwrite" if self.resume else "errorifexists"
                frame.write.mode(mode).parquet(path)
            _SCHEMAS[path] = schema
        return self.spark.read.schema(schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled leaves the disk when the query ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


#: Rows that one shuffle partition stands for, and the bytes that adaptive execution joins partitions to.
SHUFFLE_ROWS, SHUFFLE_BYTES = 250_000, 16 << 20


def fit_shuffles(spark: SparkSession, rows: int) -> None:
    """Let the number of shuffle partitions follow the input, so that a task's memory does not.

    Adaptive execution joins what stays small; a session with more partitions
    or smaller ones keeps them.
    """
    parts, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = -(-rows // SHUFFLE_ROWS)
    if wanted > int(spark.conf.get(parts)):
        spark.conf.set(parts, wanted)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > SHUFFLE_BYTES:
        spark.conf.set(size, SHUFFLE_BYTES)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a row count; a longer table stays unhinted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partition and sort a fact table by its keys before it is written.

    Later aggregates by the leading key then combine almost fully before their
    shuffle. The trailing keys let a range boundary fall inside a huge group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
