"""Parent of a mutation's node at the mutation's position.

Edges are half-open genomic intervals per child node, and the edges of one
child never overlap. The parent at a position is that of the last edge starting
at or before it, if that edge still covers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.operators.ranks import POSITION_TILE

KEY = ["draw_id", "child"]


def parent_at(
    edges: DataFrame, points: DataFrame, tile: float = POSITION_TILE, times: str | None = None, own: DataFrame | None = None
) -> DataFrame:
    """As-of join of distinct (draw_id, child, pos) points onto edges.

    Returns every point with ``parent``, NULL where no edge covers it. A point's
    column ``times`` is passed on. ``own`` has one row (draw_id, child, below) a
    child; its ``below`` comes with the tile, so points are not joined with it.

    A child can own any share of the edges and points, so its span is cut into
    position tiles and the window runs per tile. Each tile also needs the last
    edge of the tiles before it; that carry is a per-tile aggregate followed by
    a window over tiles only. Every point and edge is shuffled once, and a
    child's edge is never copied into the tiles it spans.
    """
    extra = [times] if times else []
    tile_of = lambda c: F.floor(c / F.lit(float(tile))).cast("bigint")
    edge = F.struct(F.col("right").alias("right"), F.col("parent").alias("parent"))
    cut_edges = edges.select(*KEY, tile_of(F.col("left")).alias("tile"), "left", edge.alias("edge"))
    cut_points = points.select(
        *KEY, tile_of(F.col("pos")).alias("tile"), F.col("pos").cast("double").alias("pos"), *extra
    )

    last_in_tile = cut_edges.groupBy(*KEY, "tile").agg(F.max_by("edge", "left").alias("edge"))
    visited = cut_points.select(*KEY, "tile").distinct()
    tiles = last_in_tile.unionByName(
        visited.withColumn("edge", F.lit(None).cast(last_in_tile.schema["edge"].dataType))
    )
    earlier = W.partitionBy(*KEY).orderBy("tile").rangeBetween(W.unboundedPreceding, -1)
    carry = (
        tiles.withColumn("carried", F.last("edge", ignorenulls=True).over(earlier))
        .where(F.col("edge").isNull() & (F.col("carried").isNotNull() | F.lit(own is not None)))
        .select(
            *KEY,
            "tile",
            (F.col("tile") * F.lit(float(tile))).alias("at"),
            F.lit(0).alias("kind"),
            F.col("carried").alias("edge"),
        )
    )
    if own is not None:
        carry = carry.join(own, KEY, "left")
    stream = (
        carry.unionByName(
            cut_edges.select(*KEY, "tile", F.col("left").alias("at"), F.lit(1).alias("kind"), "edge"),
            allowMissingColumns=True,
        )
        .unionByName(
            cut_points.select(
                *KEY,
                "tile",
                F.col("pos").alias("at"),
                F.lit(2).alias("kind"),
                F.lit(None).cast(last_in_tile.schema["edge"].dataType).alias("edge"),
                *extra,
            ),
            allowMissingColumns=True,
        )
    )
    so_far = (
        W.partitionBy(*KEY, "tile")
        .orderBy("at", "kind")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    covering = stream.withColumn("found", F.last("edge", ignorenulls=True).over(so_far))
    if own is not None:
        # The tile's own row is its first.
        covering = covering.withColumn("below", F.first("below").over(so_far))
        extra = [*extra, "below"]
    covered = F.col("at") < F.col("found.right")
    return covering.where(F.col("kind") == 2).select(
        *KEY,
        F.col("at").alias("pos"),
        *extra,
        F.when(covered, F.col("found.parent")).alias("parent"),
    )


def mutation_parents(
    mutations: DataFrame, edges: DataFrame, tile: float = POSITION_TILE
) -> DataFrame:
    """Attach ``parent`` to mutations that carry (draw_id, node_id, position).

    Repeats of one (draw, node, position) collapse before the as-of join, so a
    single busy position cannot fill a window; the join back is an ordinary
    equi join that adaptive execution can split.
    """
    points = mutations.select(
        "draw_id", F.col("node_id").alias("child"), F.col("position").cast("double").alias("pos")
    ).distinct()
    found = parent_at(edges, points, tile).select(
        "draw_id",
        F.col("child").alias("node_id"),
        F.col("pos").alias("_pos"),
        "parent",
    )
    keyed = mutations.withColumn("_pos", F.col("position").cast("double"))
    return keyed.join(found, ["draw_id", "node_id", "_pos"], "left").drop("_pos")


def interval_counts(mutations: DataFrame, edges: DataFrame, nodes: DataFrame, tile: float = POSITION_TILE) -> DataFrame:
    """(draw_id, below, above, times): the usable intervals of mutations, repeats of a point as one row.

    What ``with_ages`` gives with ``above``, for aggregates that need neither
    the mutation nor its place: edges bring their parent's age, tiles their
    child's and points their number, so mutations are not joined back.
    """
    point = ["draw_id", F.col("node_id").alias("child"), F.col("position").cast("double").alias("pos")]
    points = mutations.dropna(subset=["draw_id", "node_id"]).groupBy(*point).agg(F.count("*").alias("times"))
    older = nodes.select("draw_id", F.col("node_id").alias("parent"), F.col("time").alias("above"))
    aged = edges.join(older, ["draw_id", "parent"], "left").drop("parent").withColumnRenamed("above", "parent")
    own = nodes.select("draw_id", F.col("node_id").alias("child"), F.col("time").alias("below"))
    found = parent_at(aged, points, tile, "times", own).where("parent IS NOT NULL")
    return found.select("draw_id", "below", F.col("parent").alias("above"), "times")


def with_ages(mutations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``below`` and ``above``: the ages of the node and of its parent."""
    child = nodes.select("draw_id", "node_id", F.col("time").alias("below"))
    parent = nodes.select("draw_id", F.col("node_id").alias("parent"), F.col("time").alias("above"))
    return mutations.join(child, ["draw_id", "node_id"], "left").join(
        parent, ["draw_id", "parent"], "left"
    )


def parent_audit(
    mutations: DataFrame, edges: DataFrame, looked_up: DataFrame, tile: float = POSITION_TILE
) -> DataFrame:
    """(draw, node, position) points whose as-of parent fails a direct span test.

    The test lists each edge under every tile it touches and joins on the tile
    with the span as a filter: an independent form of the same lookup, whose
    candidates per point are the edges of one child within one tile.
    """
    point = ["draw_id", "node_id", "position"]
    first = F.floor(F.col("left") / tile)
    final = F.greatest(first, F.ceil(F.col("right") / tile) - 1)
    spans = edges.select(
        "draw_id",
        F.col("child").alias("node_id"),
        F.col("left").alias("_left"),
        F.col("right").alias("_right"),
        F.col("parent").alias("direct_parent"),
        F.explode(F.sequence(first, final)).alias("_tile"),
    )
    nothing = F.lit(None).cast(looked_up.schema["parent"].dataType)
    both = mutations.select(*point, nothing.alias("parent"), F.lit(0).alias("_seen")).unionByName(
        looked_up.select(*point, "parent", F.lit(1).alias("_seen"))
    )
    # A point once, with all that was looked up for it.
    points = both.groupBy(*point).agg(
        F.min("parent").alias("parent"), F.max("parent").alias("_most"),
        (F.count("parent") == F.sum("_seen")).alias("_whole"), F.sum("_seen").alias("_seen"), F.max(1 - F.col("_seen")).alias("_wanted"),
    ).where("_wanted = 1")
    tiled = points.withColumn("_tile", F.floor(F.col("position") / tile)).alias("p")
    on = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in ("draw_id", "node_id", "_tile")]
    covered = (F.col("s._left") <= F.col("p.position")) & (F.col("p.position") < F.col("s._right"))
    joined = tiled.join(spans.alias("s"), [*on, covered], "left").select("p.*", "s.direct_parent")
    same = F.col("parent").eqNullSafe(F.col("direct_parent")) & F.col("_most").eqNullSafe(F.col("direct_parent"))
    whole = (F.col("_seen") == 0) | F.col("_whole") | F.col("direct_parent").isNull()
    return joined.where(~(same & whole)).select(*point, "parent", "direct_parent")
