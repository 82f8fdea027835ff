"""Tree tables of posterior draws as Parquet."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval import schema as layout
from coeval.sources.text_inputs import expand


@dataclass
class TreeTables:
    nodes: DataFrame
    edges: DataFrame
    sites: DataFrame
    mutations: DataFrame
    draws: int


#: A path's scheme, and how many slashes follow it, which are written in two ways.
ROOT = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)/+"


def _bare(path: str) -> str:
    return re.sub(ROOT, r"\1/", path)


def _without_draw(ddl: str) -> str:
    return ddl.split(", ", 1)[1]


def load_draws(spark: SparkSession, patterns: list[str]) -> TreeTables:
    """One folder per draw, each with nodes, edges, sites and mutations tables.

    A draw's number is its place in the expanded list. Columns are read by
    name, so a catalog pass touches only the site positions.
    """
    folders = expand(spark, patterns)
    # As many rows as the driver has listed draws.
    numbers = F.broadcast(spark.createDataFrame([(_bare(f), i) for i, f in enumerate(folders)], "_folder STRING, draw_id INT"))

    def scan(name: str, ddl: str) -> DataFrame:
        """All draws' tables in one scan; a file's folder tells its draw."""
        columns = _without_draw(ddl)
        rows = spark.read.schema(columns).parquet(*[f"{folder}/{name}" for folder in folders])
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        folder = F.regexp_replace(F.regexp_extract(path, rf"^(.*)/{name}(?:/.*)?$", 1), ROOT, "$1/")
        placed = rows.select("*", folder.alias("_folder")).join(numbers, "_folder")
        return placed.select("draw_id", *rows.columns)

    return TreeTables(
        scan("nodes", layout.NODES),
        scan("edges", layout.EDGES),
        scan("sites", layout.DRAW_SITES),
        scan("mutations", layout.MUTATIONS),
        len(folders),
    )
