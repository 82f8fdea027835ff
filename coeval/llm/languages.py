"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each of its places one binary
classifier tells the languages with +1 from those with -1 by hashed byte n-grams
of a text's letters: its weights are log ratios of the n-gram's mean share in
either group, counted over all documents learned from. A language's mean share
counts the same however many documents it has.

A second look at a bounded sample of these documents finds how often a
classifier is right on each language. These rates weight the losses of a text's
margins (loss-weighted decoding): the codeword of least loss names the language,
and a text is ambiguous when the runner-up is about as near.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.llm.common import M1, M2, bites, scramble, ship_by_value, short_batches
from coeval.session import RunFolder

#: Slots of n-grams; longest n-gram in bytes.
SLOTS, LONGEST = 1 << 16, 4
#: Documents of each language that rate the classifiers; at most so many in all.
RATED, RATED_ALL = 1_000, 20_000
#: Up to so many languages a code has all ways to part them; beyond, places a doubling of languages.
EXHAUSTIVE, PLACES = 5, 10
#: Added to the counts of every slot, in shares of a slot.
SMOOTHING = 0.5
#: Languages that a task counts at a time.
HELD = 64
#: Score of the best below which a text is ambiguous.
CLEAR = 0.6
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category."""
    return any(map(str.isalpha, text))


def slots_of(text: str) -> np.ndarray:
    """Slots of the n-grams of a text's words, each word between two spaces; equal n-grams as often as they occur."""
    plain = unicodedata.normalize("NFC", text).lower()
    data = np.frombuffer(f" {' '.join(WORD.findall(plain))} ".encode(), np.uint8).astype(np.uint64)
    out, gram, salts = [], np.zeros(len(data), np.uint64), np.arange(LONGEST + 1, dtype=np.uint64) * M1
    for n in range(1, LONGEST + 1):
        if len(data) < n:
            break
        gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        out.append(scramble(gram * M2 + salts[n]) % np.uint64(SLOTS))
    return np.concatenate(out).astype(np.int64)


def codewords(count: int) -> np.ndarray:
    """One row of +1 and -1 for every language.

    Few languages get every way to part them. More get a number of places that
    grows as their logarithm, from the draw, of a fixed row of draws, whose two
    nearest rows are farthest apart.
    """
    if count <= EXHAUSTIVE:
        places = max(1, (1 << max(count - 1, 0)) - 1)
        part = np.arange(places)[None, :] + 1
        return np.array([np.where(part[0] >> i & 1, 1, -1) for i in range(count)], np.int8).reshape(count, places)
    places = int(np.ceil(PLACES * np.log2(count)))
    best, most = None, -1
    for draw in range(32):
        code = np.random.default_rng(draw).choice(np.array([-1, 1], np.int8), (count, places))
        code[0, (code == code[0]).all(axis=0)] *= -1
        near = places - (code.astype(np.int32) @ code.T.astype(np.int32) + places) // 2 + places * np.eye(count, dtype=np.int32)
        if near.min() > most:
            best, most = code, int(near.min())
    return best


def _counts():
    """(lang, bytes) to (lang, slot, n), added up within a task."""

    def send(held):
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "slot": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in bites(batches, 1):
            slots: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                slots.setdefault(lang, []).append(slots_of(text.as_py().decode("utf-8", "replace")))
            for lang, found in slots.items():
                if lang not in held and len(held) >= HELD:
                    yield from send(held)
                    held.clear()
                counts = np.bincount(np.concatenate(found), minlength=SLOTS)
                held[lang] = held[lang] + counts if lang in held else counts
        yield from send(held)

    return run


def margins(weights: np.ndarray, text: str) -> np.ndarray:
    """What each classifier says of a text: its mean weight, times the root of the number of n-grams."""
    slots = slots_of(text)
    return weights[slots].sum(axis=0, dtype=np.float64) / np.sqrt(len(slots))


def _rates(model):
    """(lang number, bytes) to (lang number, place, right, all), added up within a task."""

    def run(batches):
        weights, code = model.value
        right, every = np.zeros(code.shape, np.int64), np.zeros(len(code), np.int64)
        for batch in bites(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                right[lang] += margins(weights, text.as_py().decode("utf-8", "replace")) * code[lang] > 0
                every[lang] += 1
        lang, place = np.nonzero(np.repeat(every[:, None], code.shape[1], axis=1))
        yield pa.record_batch({"lang": pa.array(lang, pa.int64()), "place": pa.array(place, pa.int64()), "right": right[lang, place], "n": every[lang]})

    return run


def decode(found: np.ndarray, code: np.ndarray, rates: np.ndarray) -> tuple[int, float]:
    """The language of least weighted loss, and its share of exp(-loss) among all."""
    loss = (rates * np.logaddexp(0, -code * found)).sum(axis=1)
    odds = np.exp(loss.min() - loss)
    return int(loss.argmin()), float(odds.max() / odds.sum())


def _labeller(model):
    """(row, bytes) to (row, lang, score, ambiguous)."""

    def run(batches):
        names, weights, code, rates = model.value
        for batch in bites(batches, 1):
            langs, scores = [], []
            for text in batch.column(1):
                text = (text.as_py() or b"").decode("utf-8", "replace")
                if names and has_letter(text):
                    best, score = decode(margins(weights, text), code, rates)
                    langs.append(names[best])
                    scores.append(score)
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            unclear = [x == UNKNOWN or s < CLEAR for x, s in zip(langs, scores)]
            yield pa.record_batch({"row": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "ambiguous": pa.array(unclear, pa.bool_())})

    return run


def fit_languages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, weights by slot and place, codewords, rates) learned from texts with a language.

    All of them are counted. At most RATED documents of a language, and RATED_ALL
    or one of each language in all, taken by a hash of text and id, rate the
    classifiers. Rows without text, letters or language are left out; without any
    left there are no languages. The driver holds the model: SLOTS times the
    places of a code, and as much while counts come in.
    """
    run = RunFolder(docs.sparkSession)
    short_batches(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("bytes"), F.col(id_column).alias("id"))
    parts = known.select("lang", "bytes").mapInArrow(_counts(), "lang string, slot int, n bigint")
    counts = run.table("counts", parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    sizes = sorted((r["lang"], r["total"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    names = [name for name, _ in sizes]
    if not names:
        return [], np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.int8), np.zeros((0, 1))
    code = codewords(len(names))
    numbers = docs.sparkSession.createDataFrame([(name, i, float(total)) for i, (name, total) in enumerate(sizes)], "lang string, number bigint, total double")

    # Shares of every slot in the languages with +1, place by place.
    signs = docs.sparkSession.createDataFrame([(i, [int(p) for p in np.flatnonzero(row > 0)]) for i, row in enumerate(code)], "number bigint, places array<int>")
    shares = counts.join(F.broadcast(numbers), "lang").select("number", "slot", (F.col("n") / F.col("total")).alias("share"))
    whole = shares.groupBy("slot").agg(F.sum("share").alias("share")).select("slot", F.lit(-1).alias("place"), "share")
    plus = shares.join(F.broadcast(signs), "number").select("slot", F.explode("places").alias("place"), "share").groupBy("slot", "place").agg(F.sum("share").alias("share")).select("slot", "place", "share")
    table = whole.unionAll(plus).toPandas()
    every, first = np.zeros(SLOTS), np.zeros((SLOTS, code.shape[1]))
    every[table["slot"][table["place"] < 0]] = table["share"][table["place"] < 0]
    table = table[table["place"] >= 0]
    first[table["slot"], table["place"]] = table["share"]
    have, lack = (code > 0).sum(axis=0), (code < 0).sum(axis=0)
    base = SMOOTHING / np.mean([total for _, total in sizes])
    weights = (np.log(first / np.maximum(have, 1) + base) - np.log(np.maximum(every[:, None] - first, 0) / np.maximum(lack, 1) + base)).astype(np.float32)

    each = max(1, min(RATED, RATED_ALL // len(names)))
    order = F.xxhash64("bytes", F.col("id").cast("string"))
    # The n smallest hashes of a language are kept within tasks before they meet.
    picked = known.join(F.broadcast(numbers), "lang").select("number", "bytes", order.alias("key"))
    cut = run.table("keys", _smallest(picked.select("number", "key"), each))
    rated = picked.join(F.broadcast(cut), ["number", "key"], "left_semi").dropDuplicates(["number", "key"]).select("number", "bytes")
    model = docs.sparkSession.sparkContext.broadcast((weights, code))
    found = rated.mapInArrow(_rates(model), "lang bigint, place bigint, right bigint, n bigint").groupBy("lang", "place").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()
    rates = np.full(code.shape, 0.5)
    for r in found:
        rates[r["lang"], r["place"]] = (r["right"] + 1) / (r["n"] + 2)
    return names, weights, code, rates / rates.sum(axis=1, keepdims=True) * np.sqrt(code.shape[1])


def _smallest(rows: DataFrame, each: int) -> DataFrame:
    return rows.distinct().withColumn("r", F.row_number().over(W.partitionBy("number").orderBy("key"))).filter(F.col("r") <= each).drop("r")


def languages(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred string, score double, ambiguous boolean) of every row.

    ``score`` is the nearest codeword's share, 0 to 1. Null and empty texts and
    texts without a letter are ``und`` with score 0, and so are all without a
    learned language; ``ambiguous`` is true for them and where the score is
    below CLEAR. Of codewords equally near the first language by name is taken.
    Very long texts are read whole. Repeated rows are judged one by one; null ids
    are passed on. An empty table gives no rows; other columns are not read.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.struct(F.col(id_column).alias("id")).alias("row"), F.col(text).cast("binary").alias("bytes"))
    found = plain.mapInArrow(_labeller(shared), f"row struct<id:{kind}>, lang_pred string, score double, ambiguous boolean")
    return found.select(F.col("row.id").alias(id_column), "lang_pred", "score", "ambiguous")


def is_held_out(id_column: str, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


ship_by_value(__name__)
