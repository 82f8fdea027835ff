"""How far the sources of a language differ in their words, by chunk factorization.

A chunk is a stretch of text between ASCII white space, so no term crosses one.
Tasks count the chunks of every document once and add documents and occurrences
by (lang, source, chunk). Every chunk that is left is cut into terms once, and
its terms are joined back to its counts.

Documents with a term are bounded by its chunks': at least those of its most
frequent chunk, at most those of all of them together. Only where the two lie on
either side of the least number of documents are the chunks, each of them rare,
looked up in the texts again and distinct documents counted.

Shares are integers in units of 10^-9, and all arithmetic is on integers. Terms
are dealt to tiles and sources to blocks, so a task holds a tile of terms for
two blocks of sources at most, and adds what each pair differs by there.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.llm.common import bites, drop_table, lower_ascii, ship_by_value, short_batches
from coeval.session import RunFolder

#: Runs of ASCII letters and of all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term needs; terms listed for a group.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Unit of a share, as its third root, which keeps products of counts below 2^63.
UNIT_ROOT = 1_000
#: Bytes of counts, and groups, that a task holds before it adds them up and sends them on.
COUNTED_BYTES, NAMED = 96 << 20, 100_000
#: Slots that say which chunks of a language are looked up again.
SLOTS = 1 << 22
#: Most kept terms, and their bytes, that are sent to every task; more are joined by a shuffle.
SENT, SENT_BYTES = 500_000, 16 << 20
#: Mask of the lower half of a 64-bit number.
LOW = (1 << 32) - 1
#: Sources of a block, and counts of a tile of terms.
BLOCK, TILE = 64, 25_000


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """All chunks of some texts, as codes into the distinct ones, and the text that each is of."""
    cut = pc.ascii_split_whitespace(pc.cast(texts, pa.string(), safe=False) if texts.type == pa.string() else texts.view(pa.string()))
    flat = cut.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(cut), dtype=np.int64), np.diff(cut.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    return doc, flat.filter(full).dictionary_encode()


def _distinct(doc: np.ndarray, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of every chunk of every text."""
    pairs, times = np.unique(doc << 32 | coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return pairs >> 32, pairs & LOW, times


def _chunk_counts():
    """(lang, source, bytes) to (lang, source, chunk, docs, times), added up within a task; chunk '' counts a group's documents."""

    def send(pieces, names):
        added = pa.concat_tables(pieces).group_by(["group", "chunk"], use_threads=False).aggregate([("docs", "sum"), ("times", "sum")]).combine_chunks()
        for piece in added.to_batches():
            named = [pa.array([n[k] for n in names], pa.string()).take(piece.column("group")) for k in (0, 1)]
            yield pa.record_batch({"lang": named[0], "source": named[1], "chunk": piece.column("chunk").view(pa.binary()), "docs": piece.column("docs_sum"), "times": piece.column("times_sum")})

    def run(batches):
        names: dict[tuple, int] = {}
        pieces, size = [], 0
        for batch in bites(batches, 2):
            of = np.array([names.setdefault(g, len(names)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            text, coded = _words(batch.column(2))
            doc, code, times = _distinct(text, coded)
            keys, place = np.unique(of[doc] << 32 | code, return_inverse=True)
            groups, docs = np.unique(of, return_counts=True)
            pieces.append(pa.table({
                "group": pa.array(np.concatenate([keys >> 32, groups])),
                "chunk": pa.concat_arrays([coded.dictionary.take(pa.array(keys & LOW)), pa.repeat(pa.scalar("", pa.string()), len(groups))]),
                "docs": pa.array(np.concatenate([np.bincount(place, minlength=len(keys)), docs])),
                "times": pa.array(np.concatenate([np.bincount(place, times, len(keys)).astype(np.int64), np.zeros(len(groups), np.int64)])),
            }))
            size += pieces[-1].nbytes
            if size >= COUNTED_BYTES or len(names) >= NAMED:
                yield from send(pieces, list(names))
                names, pieces, size = {}, [], 0
        if pieces:
            yield from send(pieces, list(names))

    return run


def _recount(slots):
    """(row, lang, bytes) to (row, lang, chunk) of chunks whose slot is set."""

    def run(batches):
        marked = np.unpackbits(slots.value, bitorder="little")
        for batch in bites(batches, 2):
            at, chunks = [], []
            before = [zlib.crc32(x.encode() + b"\0") for x in batch.column(1).to_pylist()]
            for i, text in enumerate(batch.column(2)):
                words = list(set(text.as_py().split()))
                places = np.fromiter(map(zlib.crc32, words, repeat(before[i])), np.int64, len(words)) % SLOTS
                hit = np.nonzero(marked[places])[0].tolist()
                at += [i] * len(hit)
                chunks += [words[k] for k in hit]
            at = pa.array(at, pa.int64())
            yield pa.record_batch({"row": batch.column(0).take(at), "lang": batch.column(1).take(at), "chunk": pa.array(chunks, pa.binary())})

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), digit by digit: exact while total + 2 terms is below 9 * 10^15."""
    whole = total + 2 * terms
    rest, value = count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        value = value * UNIT_ROOT + F.call_function("div", rest * UNIT_ROOT, whole)
        rest = (rest * UNIT_ROOT) % whole
    return value + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums():
    """Of a tile of terms and two blocks of sources: what each pair differs by over the tile's terms, and how many those are.

    Rows without a term carry the share of a source in terms that it lacks.
    """

    def run(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).to_numpy()
        source, p, block = col("s").astype(np.int64), col("p"), col("block")
        base = table.column("term").is_null().to_numpy()
        order = np.argsort(source[base])
        names, rest, of = source[base][order], p[base][order], block[base][order]
        code = table.column("term").combine_chunks().dictionary_encode()
        places = code.indices.to_numpy(zero_copy_only=False)[~base].astype(np.int64)
        grid = np.tile(rest, (len(code.dictionary), 1))
        grid[places, np.searchsorted(names, source[~base])] = p[~base]
        low, high = (int(table.column(k)[0].as_py()) for k in ("low", "high"))
        made: tuple[list, list, list] = ([], [], [])
        for i in np.nonzero(of == low)[0]:
            others = np.nonzero((of == high) & (names > names[i]))[0]
            if len(others):
                mine, theirs = grid[:, i : i + 1], grid[:, others]
                made[0].append(np.full(len(others), names[i]))
                made[1].append(names[others])
                made[2].append(((mine - theirs) ** 2 // (mine + theirs)).sum(axis=0))
        a, b, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in made)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "total": total, "terms": pa.array(np.full(len(a), len(grid)), pa.int64())})

    return run


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value bigint, rank int) of every (lang, source) that occurs.

    Part ``pair`` ranks the other sources of the language by what they differ
    by, part ``term`` at most ``top`` terms that the source has more of than its
    language. Terms in fewer than ``least_docs`` documents of a language are
    left out. Equal values rank by the item's bytes.

    Null languages, sources and texts are empty ones. A row is a document, also
    if it repeats another or has no id. Very long texts are read whole. A group
    without terms takes part with counts of zero; without kept terms all values
    of pairs are 0 and no terms are listed. A source alone in its language has
    no pairs. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    run = RunFolder(spark)
    short_batches(spark)
    named = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    plain = docs.select(named(lang).alias("lang"), named(source).alias("source"), F.coalesce(text, F.lit("")).cast("binary").alias("bytes"))
    partial = plain.mapInArrow(_chunk_counts(), "lang string, source string, chunk binary, docs bigint, times bigint")
    # Tasks have added up what they can: shuffled first, rows are not hashed twice.
    counts = run.table("chunks", partial.repartition("lang", "source", "chunk").groupBy("lang", "source", "chunk").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")))
    groups = run.table("groups", counts.filter("chunk = X''").select("lang", "source"))

    # Every distinct chunk is cut into terms once.
    found = counts.filter("chunk <> X''").select("chunk").distinct().select("chunk", F.regexp_extract_all(lower_ascii(F.col("chunk").cast("string")), F.lit(TERM), 0).alias("terms"))
    cut = run.table("cut", found.filter(F.size("terms") > 0))
    # Chunks are distinct there, so its hash tables are even.
    spread = counts.join(cut.hint("shuffle_hash"), "chunk").select("lang", "source", "docs", "times", F.explode("terms").alias("term"))
    terms = run.table("terms", spread.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("times").alias("n"), F.max("docs").alias("low"), F.sum("docs").alias("high")))
    drop_table(run, "chunks")
    kept = _kept_terms(run, plain, terms, cut, least_docs)

    had = run.table("had", terms.join(_sendable(kept), ["lang", "term"]).select("lang", "source", "term", "n"))
    by_lang = W.partitionBy("lang")
    sizes = had.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    numbered = groups.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n_group", "v"])
    numbered = numbered.withColumn("n_lang", F.sum("n_group").over(by_lang)).withColumn("s", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("bigint"))
    numbered = run.table("numbered", numbered.withColumn("sources", F.count("*").over(by_lang)).withColumn("z", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("n_group"), F.col("v"))).otherwise(1)))
    shares = run.table("shares", had.join(numbered, ["lang", "source"]).select("lang", "source", "s", "sources", "term", "n", share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), "v", "n_lang"))
    return _term_part(shares, top).unionAll(_pair_part(run, numbered, shares))


def _sendable(kept: DataFrame) -> DataFrame:
    """Broadcast hint behind a count of rows and bytes."""
    rows, size = kept.agg(F.count("*"), F.sum(F.octet_length("lang") + F.octet_length("term"))).first()
    return F.broadcast(kept) if rows <= SENT and (size or 0) <= SENT_BYTES else kept


def _kept_terms(run: RunFolder, plain: DataFrame, terms: DataFrame, cut: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms in ``least`` documents of the language or more."""
    bounds = terms.groupBy("lang", "term").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).filter(F.col("high") >= least)
    bounds = run.table("bounds", bounds)
    open_terms = bounds.filter(F.col("low") < least).select("lang", "term")
    again = cut.select("chunk", F.explode(F.array_distinct("terms")).alias("term")).join(open_terms, "term").select("lang", "chunk", "term")
    again = run.table("again", again)
    slot = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("chunk"))) % SLOTS
    words = again.select(F.shiftright(slot, 5).alias("word"), (slot % 32).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("bits")).collect()
    certain = bounds.filter(F.col("low") >= least).select("lang", "term")
    if not words:
        return certain
    slots = np.zeros(SLOTS // 32, np.uint32)
    slots[[r["word"] for r in words]] = [r["bits"] for r in words]
    shared = run.spark.sparkContext.broadcast(slots.view(np.uint8))
    rows = plain.select(F.monotonically_increasing_id().alias("row"), "lang", "bytes")
    # Written, so that all chunks of a document come with the same row number.
    seen = run.table("seen", rows.mapInArrow(_recount(shared), "row bigint, lang string, chunk binary"))
    exact = seen.join(again, ["lang", "chunk"]).select("lang", "term", "row").distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))
    return run.table("kept", certain.unionAll(exact.filter(F.col("docs") >= least).select("lang", "term")))


def _term_part(shares: DataFrame, top: int) -> DataFrame:
    of_lang = shares.groupBy("lang", "term").agg(F.sum("n").alias("n_all"))
    rows = shares.join(of_lang, ["lang", "term"]).withColumn("q", share(F.col("n_all"), F.col("n_lang"), F.col("v"))).filter("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def _pair_part(run: RunFolder, numbered: DataFrame, shares: DataFrame) -> DataFrame:
    tiles = max(1, -(-shares.count() // TILE))
    block, blocks = F.floor(F.col("s") / BLOCK).cast("int"), F.ceil(F.col("sources") / BLOCK).cast("int")
    held = shares.select("lang", "s", "sources", "term", "p", F.pmod(F.xxhash64("term"), F.lit(tiles)).cast("int").alias("tile"))
    base = numbered.select("lang", "s", "sources", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    rows = held.unionAll(base).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("lang", "tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "s", "block", "term", "p")
    sums = rows.groupBy("lang", "tile", "low", "high").applyInArrow(_pair_sums(), "lang string, a bigint, b bigint, total bigint, terms bigint")
    sums = run.table("sums", sums.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms")))
    end = lambda k: numbered.select("lang", F.col("s").alias(k), F.col("source").alias(f"source_{k}"), F.col("z").alias(f"z_{k}"), *(["v"] if k == "a" else []))
    rows = sums.join(end("a"), ["lang", "a"]).join(end("b"), ["lang", "b"])
    value = F.when(F.col("v") > 0, F.col("total") + (F.col("v") - F.col("terms")) * gap(F.col("z_a"), F.col("z_b"))).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    rows = rows.select("lang", value.alias("value"), both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


ship_by_value(__name__)
