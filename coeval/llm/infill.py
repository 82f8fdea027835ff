"""Fill-in-the-middle documents, cut at places selected from a compressed boundary set.

The byte offsets at which a text may be cut form a set, kept as the Roaring
format keeps one: the upper bits of an offset name a container of 2^16 offsets,
and each container is whichever is smallest of a sorted array, a bitmap and a
list of runs. Cumulative cardinalities find the container of the k-th offset,
and a select inside it finds the offset. A text takes two such selects, for the
ends of its prefix and of its middle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coeval.llm.common import bites, ship_by_value, short_batches

#: Offsets of a container.
SPAN = 1 << 16
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts: how many stay plain, and how many of the others put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _char_starts(data: np.ndarray, before: int) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _line_starts(data: np.ndarray, before: int) -> np.ndarray:
    return np.concatenate([[before], data[:-1]]) == 10


def _word_starts(data: np.ndarray, before: int) -> np.ndarray:
    space = SPACE[data]
    return ~space & np.concatenate([[SPACE[before]], space[:-1]])


#: Where units start, from bytes and the byte before them; offset 0 and the text's end are always boundaries.
UNITS = {"char": _char_starts, "word": _word_starts, "line": _line_starts}


class ArrayContainer:
    def __init__(self, flags: np.ndarray) -> None:
        self.places = np.flatnonzero(flags).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class BitmapContainer:
    """Words of 64 bits, with how many are set before each."""

    def __init__(self, flags: np.ndarray) -> None:
        padded = np.zeros(SPAN, bool)
        padded[: len(flags)] = flags
        self.bits = np.packbits(padded, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(padded.reshape(-1, 64).sum(axis=1))]).astype(np.uint32)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.bits[8 * word : 8 * word + 8], bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - int(self.before[word])])


class RunContainer:
    """First offsets of runs, with how many offsets are in the runs before each."""

    def __init__(self, flags: np.ndarray) -> None:
        edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.uint32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(flags: np.ndarray):
    """The smallest container: 2 bytes an offset, 4 a run, or 8 KiB."""
    held = int(np.count_nonzero(flags))
    runs = int(flags[0]) + int(np.count_nonzero(flags[1:] & ~flags[:-1]))
    cost = {RunContainer: 4 * runs, ArrayContainer: 2 * held, BitmapContainer: SPAN // 8}
    return min(cost, key=cost.get)(flags)


class Boundaries:
    """Offsets at which a text of bytes may be cut, 0 and its length among them."""

    def __init__(self, text: bytes, unit: str = "char") -> None:
        data, starts = np.frombuffer(text, np.uint8), UNITS[unit]
        self.containers, held = [], [0]
        for at in range(0, len(data) + 1, SPAN):
            piece = data[at : at + SPAN]
            flags = starts(piece, int(data[at - 1]) if at else 0) if len(piece) else np.zeros(0, bool)
            if not at and len(flags):
                flags[0] = True
            if len(piece) < SPAN:
                flags = np.append(flags, True)
            self.containers.append(container(flags))
            held.append(held[-1] + int(np.count_nonzero(flags)))
        self.cumulative = np.array(held, np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        i = int(np.searchsorted(self.cumulative, k, side="right")) - 1
        return i * SPAN + self.containers[i].select(k - int(self.cumulative[i]))


def _writer(unit: str, sentinels: tuple[bytes, bytes, bytes]):
    """(row, bytes, first, second, form) to (row, n, form, prefix, middle, output)."""
    p, s, m = sentinels

    def run(batches):
        for batch in bites(batches, 1):
            made: dict[str, list] = {"n": [], "prefix": [], "middle": [], "output": []}
            for text, first, second, form in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                text = text.as_py()
                cuts = Boundaries(text, unit)
                n = len(cuts) - 1
                made["n"].append(n)
                if form == "plain":
                    low = high = None
                    output = text
                else:
                    low, high = sorted((first % (n + 1), second % (n + 1)))
                    a, b = cuts.select(low), cuts.select(high)
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    output = b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))
                made["prefix"].append(low)
                made["middle"].append(None if low is None else high - low)
                made["output"].append(output)
            kinds = {"output": pa.binary()}
            yield pa.record_batch({"row": batch.column(0), "form": batch.column(4)} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in made.items()})

    return run


def _check(sentinels: tuple[str, str, str], unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels with characters are needed")
    for x in sentinels:
        for y in sentinels:
            if x is not y and x in y or any(x.endswith(y[:k]) for k in range(1, len(y))):
                raise ValueError("a sentinel may neither hold another nor end as one begins")


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    plain: int = PLAIN,
    suffix_first: int = SUFFIX_FIRST,
    sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = "char",
) -> DataFrame:
    """(id, n bigint, form, prefix bigint, middle bigint, output string) of every row.

    ``n`` counts the units of the text: code points, words with what follows
    them, or lines. Two numbers drawn from the seed and the id say after how many
    units the prefix and the middle end. ``form`` is psm (prefix, suffix,
    middle), spm (suffix, prefix, middle) or plain: an empty text, one that holds
    a sentinel, and ``plain`` of a hundred others are left as they are, and have
    null for ``prefix`` and ``middle``, the units of these parts.
    ``restored`` gives the text back.

    Null texts are empty. Very long texts are cut whole. Rows that repeat an id
    are cut each by itself, with the same two numbers; a null id draws as an
    empty one. An empty table gives no rows; other columns are not read.
    """
    _check(sentinels, unit)
    short_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")
    holds = F.lit(False)
    for mark in sentinels:
        holds = holds | F.contains(body, F.lit(mark))
    form = F.when((F.length(body) == 0) | holds | (number(3) % 100 >= 100 - plain), "plain").when(number(4) % 100 < suffix_first, "spm").otherwise("psm")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.struct(F.col(id_column).alias("id")).alias("row"), body.cast("binary").alias("bytes"), number(1).alias("first"), number(2).alias("second"), form.alias("form"))
    made = rows.mapInArrow(_writer(unit, tuple(x.encode() for x in sentinels)), f"row struct<id:{kind}>, form string, n bigint, prefix bigint, middle bigint, output binary")
    return made.select(F.col("row.id").alias(id_column), "n", "form", "prefix", "middle", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels))
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


ship_by_value(__name__)
