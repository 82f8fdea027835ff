"""Connected components of a link table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.session import RunFolder

MAX_ROUNDS = 60


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(run: RunFolder, step: str, links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``links`` has bigint columns ``a`` and ``b``. Alternates large-star and
    small-star rounds: every node hands its larger neighbours, then its smaller
    ones, to the smallest it knows. A hub's neighbours are never gathered; each
    round is an aggregate by node joined back to the links. Null ends and loops
    are left out; no links give no rows. Returns (node, label), every node once.
    """
    edges = run.table(
        f"{step}-0",
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
    )
    stamp = _stamp(edges)
    for i in range(1, MAX_ROUNDS):
        if not stamp[0]:
            break
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = run.table(f"{step}-{i}l", large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        )
        edges = run.table(f"{step}-{i}", small.filter("a <> b").distinct())
        before, stamp = stamp, _stamp(edges)
        if stamp == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots)
