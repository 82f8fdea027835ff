import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coeval.llm.infill import SPAN, Boundaries, container, fill_in_middle, restored


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = text[:i], text[i:j], text[j:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", i, j - i, f"<S>{c}<P>{a}<M>{b}", text)
    return (doc_id, n, "psm", i, j - i, f"<P>{a}<S>{c}<M>{b}", text)


def texts():
    rng = random.Random(5)
    alphabet = "ab <PSM>\n\x00éß漢🙂́"
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows += ["", None, "x<P>y", "<S", "a" * 200_000, "é漢a" * 60_000, "🙂" * (SPAN // 4), "\n" * SPAN, "ab\n" * 50_000 + "漢" * 40_000]
    return list(enumerate(rows)) + [(3, rows[3]), (None, "a text without id"), (None, None)]


def test_matches_slices_of_code_points(spark):
    df = spark.createDataFrame(texts(), "doc_id bigint, text string").withColumns({"row": F.lit(1), "form": F.lit("x"), "output": F.lit(2), "bytes": F.lit(0)}).repartition(3)
    cut = fill_in_middle(df)
    got = sorted((tuple(r) for r in cut.select("*", restored(F.col("output"), F.col("form"))).collect()), key=str)
    assert got == sorted((brute(*r) for r in texts()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_every_boundary_is_selected(unit):
    rng = random.Random(7)
    for alphabet, size in (("a", 3 * SPAN), ("aé", 70_000), ("a \n", 70_000), ("a" * 5_000 + "\n", 300_000), ("漢", SPAN // 3 + 9), ("é🙂 ", 3_000), ("a", SPAN), ("a", 0)):
        text = "".join(rng.choice(alphabet) for _ in range(size)).encode()
        data = text.decode()
        space = lambda c: c in " \t\n\r\x0b\x0c"
        begins = {"char": lambda x, y: True, "line": lambda x, y: x == "\n", "word": lambda x, y: space(x) and not space(y)}[unit]
        sizes = np.cumsum([0] + [len(c.encode()) for c in data])
        want = np.unique([0, len(text)] + [sizes[i] for i in range(1, len(data)) if begins(data[i - 1], data[i])])
        cuts = Boundaries(text, unit)
        assert len(cuts) == len(want)
        picks = range(len(want)) if len(want) < 500 else [0, len(want) - 1, *rng.sample(range(len(want)), 300)]
        assert [cuts.select(k) for k in picks] == [want[k] for k in picks]


def test_smallest_container_is_taken():
    rng = np.random.default_rng(1)
    kinds = [type(container(x)).__name__ for x in (np.ones(SPAN, bool), np.arange(SPAN) % 50 == 0, rng.random(SPAN) < 0.5)]
    assert kinds == ["RunContainer", "ArrayContainer", "BitmapContainer"]


def test_other_settings_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"one two\nthree {i}\n\nfour é") for i in range(60)], "id bigint, body string")
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    cut = fill_in_middle(df, "id", "body", seed=9, plain=0, suffix_first=100, sentinels=marks, unit="line")
    rows = cut.join(df, "id").select("*", restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert all(r["form"] == "spm" and r["n"] == 4 and r["back"] == r["body"] for r in rows)
    assert fill_in_middle(df.limit(0), "id", "body").collect() == []
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "x", "y"), ("a", "", "b")):
        with pytest.raises(ValueError):
            fill_in_middle(df, "id", "body", sentinels=bad)
    with pytest.raises(ValueError):
        fill_in_middle(df, "id", "body", unit="page")
