"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of ten consecutive words; a shorter item is one
window. A window's shingles are its runs of three words (fewer if it is that
short), all of which a text must have to contain it, so any one of them is a
sufficient prefix: the join takes the rarest. One scan of the texts counts the
benchmark's shingles in them, which orders these by rarity and drops windows
with one that no text has. A second scan joins the prefix shingles by place; length and positional bounds place the window
in the text, and its words are compared with the text's there.

Windows are joined in blocks of a fixed number, each block small enough to be
sent to every task, so words are never shuffled whatever the benchmark's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.llm.common import drop_table, lower_ascii, small_side
from coeval.session import RunFolder

#: Words of a window and of a shingle; windows or shingles sent to every task at a time.
WINDOW, SHINGLE, BLOCK = 10, 3, 200_000

#: What stands between words: ASCII characters that are neither letters nor digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words as they are written; comparing them lowers A-Z."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _folded(text: Column) -> Column:
    """All letters lowered, each alike wherever it stands: only a capital sigma's lower form depends on what follows."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def _plain(words: Column) -> Column:
    return F.transform(words, lower_ascii)


def _shingles(texts: DataFrame, words: str, width: int, place: str) -> DataFrame:
    """The rows with ``place`` and ``shingle``, a hash of the ``width`` words from there.

    Words past the end are null and hash to what no shingle within a text has.
    The outer form is used because Spark infers filters for the other, which
    would cut the texts into words once more.
    """
    spread = texts.select("*", F.posexplode_outer(words).alias(place, "word"))
    after = [F.get(words, F.col(place) + k) for k in range(1, width)]
    return spread.withColumn("shingle", F.when(F.col(place) + width <= F.size(words), F.xxhash64(F.lit(width), "word", *after))).drop("word")


def _windows(benchmark: DataFrame, item: str, text: str, window: int, nameless: bool) -> DataFrame:
    """(wid, item, words, k) of every window; equal windows share a wid."""
    listed = benchmark if nameless else benchmark.filter(F.col(item).isNotNull())
    items = listed.select(F.col(item).cast("string").alias("item"), _plain(words_of(F.col(text))).alias("all")).filter(F.size("all") > 0)
    k = F.least(F.lit(window), F.size("all"))
    starts = F.sequence(F.lit(1), F.size("all") - k + 1)
    cut = items.select("item", k.alias("k"), "all", F.explode(starts).alias("s")).select("item", "k", F.slice("all", F.col("s"), F.col("k")).alias("words"))
    return cut.withColumn("wid", F.sha2(F.concat_ws(" ", "words"), 256)).distinct()


def _blocks(run: RunFolder, rows: DataFrame, step: str, key: str) -> list[DataFrame]:
    """The rows in parts of about BLOCK at most, dealt by a hash of the key."""
    count = max(1, -(-rows.count() // BLOCK))
    if count == 1:
        return [rows]
    dealt = run.table(step, rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(count))))
    return [dealt.filter(F.col("block") == b).drop("block") for b in range(count)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, nameless: bool = False) -> DataFrame:
    """Where texts contain windows of benchmark items.

    Returns one row for every distinct (id, text) with a hit: key bigint
    (``row_key``), spans array<struct<start, stop>> of hit words in order, items
    array<string>, the items with occurring windows, sorted, unnamed boolean,
    whether windows of items without an id occur.

    Null and empty texts and items have no words and no windows; an item without
    an id is left out, or if ``nameless`` is set only its name is; repeated items
    count once. Very long texts are read
    whole, tokens and all. Rows that repeat an id and text give one row. Empty
    tables give no rows; other columns are not read.
    """
    run = RunFolder(docs.sparkSession)
    windows = run.table("windows", _windows(benchmark, item, item_text, window, nameless))
    distinct = windows.select("wid", "words", "k", F.transform("words", _folded).alias("low")).dropDuplicates(["wid"])
    distinct = run.table("distinct", distinct.withColumn("width", F.least(F.lit(SHINGLE), "k")))
    widths = sorted(r[0] for r in distinct.select("width").distinct().collect())
    # Lowering all letters is quick and leaves the number of words as it is. It finds too
    # much at most: the words with A-Z lowered decide in the end.
    texts = docs.select(row_key(id_column, text).alias("key"), words_of(_folded(F.col(text))).alias("all"))

    nothing = distinct.filter("false").select("wid", "width", F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("shingle"))
    parts = [_shingles(distinct.filter(F.col("width") == w), "low", w, "offset").select("wid", "width", "offset", "shingle") for w in widths]
    parts = run.table("parts", reduce(DataFrame.unionAll, parts, nothing).filter("shingle is not null"))

    # Rarity of the benchmark's shingles: how often the texts have them.
    names = run.table("names", parts.select("shingle", "width").distinct())
    counts = [names.filter("false").select("shingle", F.lit(0).cast("bigint").alias("df"))]
    for block in _blocks(run, names, "name-blocks", "shingle"):
        for w in widths:
            found = _shingles(texts.select("all"), "all", w, "place").select("shingle").join(F.broadcast(block.filter(F.col("width") == w).select("shingle")), "shingle")
            counts.append(found.groupBy("shingle").agg(F.count("*").alias("df")))
    rarity = run.table("rarity", reduce(DataFrame.unionAll, counts))
    rated = parts.join(rarity, "shingle", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("rarest"))
    prefixes = rated.filter("rarest.df > 0").select("wid", "rarest.shingle", "rarest.offset").join(distinct, "wid")
    prefixes = run.table("prefixes", prefixes.select("wid", "shingle", "offset", "words", "k", "low", "width"))

    # Places of prefix shingles carry no text; texts meet theirs again to be compared.
    places = []
    for block in _blocks(run, prefixes.select("wid", "shingle", "offset", "width"), "prefix-blocks", "wid"):
        for w in widths:
            spread = _shingles(texts.select("key", "all"), "all", w, "place").select("key", "place", "shingle")
            placed = spread.join(F.broadcast(block.filter(F.col("width") == w).drop("width")), "shingle")
            places.append(placed.select("key", (F.col("place") - F.col("offset")).alias("start"), "wid").filter("start >= 0"))
    nowhere = docs.sparkSession.createDataFrame([], "key bigint, start int, wid string")
    placed = run.table("places", reduce(DataFrame.unionAll, places, nowhere).distinct().join(prefixes.select("wid", "k", "low", "words"), "wid"))
    asked = run.table("asked", placed.groupBy("key").agg(F.collect_list(F.struct("start", "k", "wid", "low", "words")).alias("asked")))
    met = docs.select(row_key(id_column, text).alias("key"), F.col(text).alias("text")).join(small_side(asked.select("key")), "key", "left_semi").dropDuplicates(["key"])
    met = met.join(asked, "key").select("key", "asked", words_of(_folded(F.col("text"))).alias("all"), words_of(F.col("text")).alias("own"))
    # Slices that end short of a window differ from it.
    here = lambda words, x: F.slice(words, x["start"] + 1, x["k"])
    true = F.filter("asked", lambda x: (here(F.col("all"), x) == x["low"]) & (F.transform(here(F.col("own"), x), lower_ascii) == x["words"]))
    hits = run.table("hits", met.select("key", F.explode_outer(true).alias("x")).filter("x is not null").select("key", "x.start", "x.k", "x.wid"))

    before = W.partitionBy("key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    runs = hits.select("key", "start", (F.col("start") + F.col("k")).alias("stop")).distinct()
    runs = runs.withColumn("new", (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(W.partitionBy("key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = hits.select("key", "wid").distinct().join(windows.select("wid", "item"), "wid").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    result = run.table("result", spans.join(items, "key"))
    for step in ("distinct", "parts", "names", "rarity", "prefixes", "places", "asked", "hits", "windows"):
        drop_table(run, step)
    return result


def row_key(id_column: str, text: str) -> Column:
    """What names a row here: a hash of its id and text."""
    return F.xxhash64(id_column, text)
