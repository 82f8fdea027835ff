"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies each of its words
should have. Whole copies are certain. What remains is an inclusion probability
p, and documents are ranked by their random odds u / (1 - u) over the inclusion
odds p / (1 - p); the documents of lowest rank are taken until their size is as
near to the remaining target as a whole document allows. A document's u depends
on its id and text alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.llm.common import small_side
from coeval.session import RunFolder

#: Weights of the sources in order, share of all sizes, most copies.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Columns that carry a row's source and its cut; dropped again.
NAME, CUT = "__coeval_source", "__coeval_cut"
#: Rows of one source that may meet in one sorted window.
SLICE_ROWS = 5_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources are in code point order, null last, and take the weights in turn.
    Each gets its weight's part of ``share`` times all sizes, at most ``most``
    times its own size; the excess goes to the others by weight until nobody is
    above. The level at which a source stops is ``most * size / weight``, so one
    pass over sources by level finds who stops: no source is filled twice.
    """
    if share > most:
        raise ValueError("the share cannot exceed the most copies of everything")
    everything = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turns = F.array(*(F.lit(float(w)) for w in weights))
    listed = sizes.withColumn("weight", F.element_at(turns, (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_level = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    below = by_level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    filled = listed.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(whole)).alias("total"),
        (F.lit(most) * F.coalesce(F.sum("source_size").over(below), F.lit(0))).alias("spent"),
        F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)).alias("left"),
    )
    level = (F.col("total") - F.col("spent")) / F.col("left")
    stops = F.lit(most) * F.col("source_size") <= level * F.col("weight")
    # Whoever stops comes before all that don't; the first of these fixes the level.
    fixed = filled.withColumn("stops", stops).withColumn("level", F.min(F.when(~stops, F.struct(F.col("source_size") / F.col("weight"), level.alias("level")))).over(whole)["level"])
    target = F.when(F.col("stops"), F.lit(most) * F.col("source_size")).otherwise(F.col("level") * F.col("weight"))
    return fixed.select("source", "source_size", target.cast("double").alias("target"))


def _rank(p: Column, draw: Column) -> Column:
    """Random odds over inclusion odds."""
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return (u / (1 - u)) / (p / (1 - p))


def mix_cuts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, certain, p, last): what decides the copies of a source's rows.

    ``certain`` copies go to every row, one more to those whose struct of rank,
    draw and id is at most ``last``; null where no row gets one more.
    """
    run = RunFolder(docs.sparkSession)
    plain = docs.select(F.col(id_column).alias("id"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"), F.xxhash64(F.col(id_column), F.col(text)).alias("draw"))
    rows = run.table("rows", plain)
    sizes = run.table("sizes", rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate).withColumn("certain", F.floor("rate"))
    targets = run.table("targets", targets.withColumn("p", F.col("rate") - F.col("certain")).withColumn("need", F.col("target") - F.col("certain") * F.col("source_size")))

    # Ranks are cut to slices of about SLICE_ROWS rows; of all but one a source needs only the sums.
    most_rows = sizes.agg(F.max("rows")).first()[0] or 0
    slices = max(1, -(-most_rows // SLICE_ROWS))
    named = targets.select(F.col("source").alias("s"), "p", "need").filter("p > 0")
    drawn = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn("rank", _rank(F.col("p"), F.col("draw")))
    # A monotone map of the rank spreads it evenly over the slices.
    even = F.col("rank") * (F.col("p") / (1 - F.col("p")))
    cell = F.least(F.floor(even / (1 + even) * F.lit(slices)), F.lit(slices - 1))
    drawn = drawn.select("s", "need", "size", cell.alias("slice"), F.struct("rank", "draw", "id").alias("place"))
    sums = drawn.groupBy("s", "slice").agg(F.sum("size").alias("held"), F.max("place").alias("end"), F.first("need").alias("need"))
    start = F.coalesce(F.sum("held").over(W.partitionBy("s").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = run.table("sums", sums.withColumn("start", start))
    # Slices below the target are taken whole; the one that crosses it is taken up to a row.
    whole = sums.filter(F.col("start") + F.col("held") <= F.col("need")).select("s", F.col("end").alias("place"))
    edge = sums.filter((F.col("start") < F.col("need")) & (F.col("start") + F.col("held") > F.col("need"))).select(F.col("s").alias("t"), F.col("slice").alias("c"), "start")
    inside = drawn.join(F.broadcast(edge), F.col("s").eqNullSafe(F.col("t")) & (F.col("slice") == F.col("c")))
    until = F.col("start") + F.sum("size").over(W.partitionBy("s", "slice").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    # The row that crosses the target is in if more of it lies below than above.
    crossed = inside.withColumn("until", until).filter(F.col("until") - F.col("size") / 2 < F.col("need")).select("s", "place")
    last = run.table("last", whole.unionAll(crossed).groupBy("s").agg(F.max("place").alias("last")))
    return targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "need", "rate")


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The table with size, source_size and target, and how many copies the mix takes.

    ``copies`` int says how often the mix repeats the row, at most ``most``
    times, rounded up. A source's taken words miss its target by at most half of
    its largest document, or of the joint size of rows that repeat id and text.
    Once the sources' cuts are known, every row's copies
    follow from itself, so texts are not shuffled.

    A null source is a source of its own. Null and empty texts have size 0.
    Very long texts are counted whole. Rows that repeat id and text draw alike
    and are taken together. An empty table gives no rows. Other columns are
    passed on; those named like the new ones are replaced.
    """
    cuts = mix_cuts(docs, id_column, text, source, weights, share, most)
    cuts = cuts.select(F.struct("source_size", "target", "certain", "p", "last").alias(CUT), F.col("source").alias(NAME))
    place = F.struct(_rank(F.col(f"{CUT}.p"), F.xxhash64(F.col(id_column), F.col(text))).alias("rank"), F.xxhash64(F.col(id_column), F.col(text)).alias("draw"), F.col(id_column).alias("id"))
    extra = F.coalesce((F.col(f"{CUT}.p") > 0) & (place <= F.col(f"{CUT}.last")), F.lit(False)).cast("int")
    joined = docs.join(small_side(RunFolder(docs.sparkSession).table("cuts", cuts)), docs[source].eqNullSafe(F.col(NAME)))
    return joined.withColumns(
        {
            "size": word_count(F.col(text)),
            "source_size": F.col(f"{CUT}.source_size"),
            "target": F.col(f"{CUT}.target"),
            "copies": (F.col(f"{CUT}.certain") + extra).cast("int"),
        }
    ).drop(CUT, NAME)
