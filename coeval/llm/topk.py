"""Exact top-k inner products by a three-phase uniform threshold.

The components of every vector are cut into ``parts`` lists; a score is the sum
of a vector's local scores, one from each list.

1. Every list gives each query its highest local scores. The vectors among them
   are scored in full; the k-th best full score t is a safe cutoff.
2. A vector that reaches t has a local score of at least t / parts in some list.
   With the cutoff at hand, the lists give all such entries.
3. Entries of one vector are added up. What its unseen lists could add is below
   t / parts each; vectors that could still reach t are scored in full.

Equal vectors are one candidate that keeps its k + 1 smallest ids, and equal
queries are one query, so a vector that fills a third of the table costs as much
as any other. Queries meet all vectors in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.llm.common import drop_table, ship_by_value
from coeval.session import RunFolder

#: Vectors and queries in a tile.
TILE_VECTORS, TILE_QUERIES = 4_096, 4_096


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))


def _merged(keep: int):
    """(id, vector) to one row a distinct vector of the batch, with its smallest ids."""

    def run(batches):
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            flat, cuts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1).value_lengths().to_numpy()
            ends = np.cumsum(cuts)
            for key, a, b in zip(batch.column(0).to_pylist(), ends - cuts, ends):
                held.setdefault(flat[a:b].tobytes(), set()).add(key)
            ids = [sorted(x)[:keep] for x in held.values()]
            yield pa.record_batch({"vector": pa.array(list(held), pa.binary()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return run


def _matrix(column, size: int) -> np.ndarray:
    """Vectors as rows of whole numbers, shorter ones filled up with 0."""
    out = np.zeros((len(column), size), np.int64)
    for i, cell in enumerate(column):
        one = np.frombuffer(cell.as_py(), "<i8")
        out[i, : len(one)] = one
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise ArithmeticError("a score does not fit 64 bits")


def _tile(keep: int, parts: int):
    """Local scores of a tile of one list: the ``keep`` highest of a query, or all that reach its cutoff."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "class": [], "list": [], "local": []}
        if len(vectors) and len(queries):
            size = max(max(len(x.as_py()) for x in t.column("piece")) for t in (vectors, queries)) // 8
            v = _matrix(vectors.column("piece"), size)
            names, wanted = vectors.column("class").to_numpy(), queries.column("query").to_numpy()
            cutoffs = queries.column("cutoff").to_pylist()
            for at in range(0, len(queries), 512):
                local = _products(_matrix(queries.column("piece").slice(at, 512), size), v)
                for i, row in enumerate(local):
                    if cutoffs[at + i] is None:
                        pick = np.argpartition(-row, keep - 1)[:keep] if keep < len(row) else np.arange(len(row))
                    else:
                        pick = np.nonzero(row >= -(-cutoffs[at + i] // parts))[0]
                    out["query"].append(np.full(len(pick), wanted[at + i]))
                    out["class"].append(names[pick])
                    out["list"].append(np.full(len(pick), vectors.column("list")[0].as_py()))
                    out["local"].append(row[pick])
        return pa.table({k: pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for k, x in out.items()})

    return run


def _pieces(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each list: ``list`` and the vector's ``piece`` of it."""
    width = F.ceil(F.octet_length("vector") / (8 * parts)).cast("int")
    cut = [F.struct(F.lit(b).alias("list"), F.substring(F.col("vector"), width * (8 * b) + 1, width * 8).alias("piece")) for b in range(parts)]
    return rows.withColumn("cut", F.explode(F.array(*cut))).select("*", "cut.list", "cut.piece").drop("cut", "vector")


def _scorer():
    """(query, class, vector, vector) to full scores."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<i8").reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64) for i in (2, 3))
            if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1]) >= 1 << 63:
                raise ArithmeticError("a score does not fit 64 bits")
            yield pa.record_batch({"query": batch.column(0), "class": batch.column(1), "score": pa.array(np.einsum("ij,ij->i", a, b), pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", embedding: str = "embedding", scale: int = 1024, parts: int = 2) -> DataFrame:
    """(query_id, rank int, id, score) of the k best other vectors of every query.

    Scores are inner products of components floor(scale * x). Ties go to the
    smaller id. ``is_query`` picks the queries among the rows; all rows are
    candidates, but for a query's own id. With fewer than k others, all of them.

    Null ids, null vectors and those with null or non-finite components take no
    part. Vectors of unequal length are filled up with zeros; an empty vector
    scores 0. Rows that repeat an id count once,
    with the smallest of their vectors. A score beyond 64 bits is an error. An empty table gives no rows; other columns are not read.
    """
    if k < 1 or parts < 1:
        raise ValueError("k and parts must be at least 1")
    keep = k + 1
    run = RunFolder(vectors.sparkSession)
    usable = vectors.select(F.col(id_column).cast("bigint").alias("id"), quantised(F.col(embedding), scale).alias("q"), is_query.alias("asks")).filter("id is not null and q is not null")
    usable = usable.groupBy("id").agg(F.min("q").alias("q"), F.max("asks").alias("asks"))
    # Vectors are padded to one length first, so that equal ones are equal bytes.
    longest = usable.agg(F.max(F.size("q"))).first()[0] or 0
    padded = usable.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), F.lit(longest) - F.size("q"))))
    packed = padded.select("id", "q").mapInArrow(_merged(keep), "vector binary, ids array<bigint>")
    ids = F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("ids")))), 1, keep)
    classes = run.table("classes", packed.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("class"), "vector", "ids"))
    asked = padded.filter("asks").select("id", "q").mapInArrow(_merged(1 << 62), "vector binary, ids array<bigint>").select("vector", F.explode("ids").alias("id"))
    asked = run.table("asked", asked.join(classes.select("vector", "class"), "vector").select("id", F.col("class").alias("query")).distinct())
    queries = run.table("queries", asked.select("query").distinct().join(classes.select(F.col("class").alias("query"), "vector"), "query"))

    tall = max(1, -(-classes.count() // TILE_VECTORS))
    wide = max(1, -(-queries.count() // TILE_QUERIES))
    tall = max(tall, min(64, classes.count() // 256))
    pieces = _pieces(classes.select("class", "vector"), parts).withColumn("row", F.pmod(F.xxhash64("class"), F.lit(tall)))
    pieces = pieces.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))

    def scan(ask: DataFrame) -> DataFrame:
        ask = _pieces(ask, parts).withColumn("col", F.pmod(F.xxhash64("query"), F.lit(wide)).cast("int"))
        ask = ask.withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tall - 1).cast("bigint"))))
        keys = ["list", "row", "col"]
        return pieces.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(_tile(keep, parts), "query bigint, class bigint, list bigint, local bigint")

    def scored(pairs: DataFrame) -> DataFrame:
        """Full scores of pairs (query, class)."""
        both = pairs.join(queries.withColumnRenamed("vector", "a"), "query").join(classes.select("class", F.col("vector").alias("b")), "class")
        return both.select("query", "class", "a", "b").mapInArrow(_scorer(), "query bigint, class bigint, score bigint")

    def listed(scores: DataFrame) -> DataFrame:
        """Rows of the classes, of which the ``keep`` best of a query are enough."""
        rows = scores.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("id"))
        return rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= keep)

    # Phase one. A list's best entries of a tile are cut to its best overall.
    first = scan(queries.withColumn("cutoff", F.lit(None).cast("bigint")))
    place = F.row_number().over(W.partitionBy("query", "list").orderBy(F.desc("local"), "class"))
    first = first.withColumn("place", place).filter(F.col("place") <= keep)
    first = run.table("first", scored(first.select("query", "class").distinct()))
    cutoff = listed(first).groupBy("query").agg(F.min(F.when(F.col("place") == keep, F.col("score"))).alias("cutoff"))
    cutoff = run.table("cutoff", cutoff.withColumn("cutoff", F.coalesce("cutoff", F.lit(-(1 << 62)))))
    # Phase two.
    entries = scan(queries.join(cutoff, "query")).groupBy("query", "class").agg(F.sum("local").alias("seen"), F.count("*").alias("lists"))
    entries = run.table("entries", entries.join(cutoff, "query"))
    # Phase three. An unseen list adds at most the largest whole number below cutoff / parts.
    unseen = F.expr(f"(cutoff - 1 - pmod(cutoff - 1, {parts})) div {parts}")
    done = entries.filter(F.col("lists") == parts).select("query", "class", F.col("seen").alias("score"))
    rest = entries.filter((F.col("lists") < parts) & (F.col("seen") + (parts - F.col("lists")) * unseen >= F.col("cutoff")))
    final = done.join(cutoff, "query").filter("score >= cutoff").select("query", "class", "score").unionAll(scored(rest.select("query", "class")))
    best = run.table("best", listed(final).select("query", "score", F.col("id").alias("found")))
    for step in ("first", "entries"):
        drop_table(run, step)
    others = asked.join(best, "query").filter("found <> id")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "found")).cast("int")
    ranked = others.select(F.col("id").alias("query_id"), rank.alias("rank"), F.col("found").alias(id_column), "score")
    return ranked.filter(F.col("rank") <= k)


ship_by_value(__name__)
