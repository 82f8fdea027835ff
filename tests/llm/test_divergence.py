import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import coeval.llm.divergence as divergence
from coeval.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        found, lang, source = [x.translate(lower) for x in TERM.findall(text or "")], lang or "", source or ""
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, every = len(kept), Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})

        def share(have):
            total = sum(have[t] for t in kept)
            return {t: 1 + 10**9 * (have[t] + 2) // (total + 2 * v) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(every)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["the", "Of", "réunion", "漢字", "x", "É", "é", *("".join(rng.choice("abcdeABC") for _ in range(4)) for _ in range(60))]
    ends = ["", "", ".", ",", "-and-the", "1", " y", "'s", "_a"]
    rows = []
    for i in range(260):
        words = [rng.choice(stems[: rng.randint(1, len(stems))]) + rng.choice(ends) for _ in range(rng.randint(0, 25))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "", None, "é", "s7"])))
    rows += [(None, None, None, None), (1, None, "xx", "one"), (2, "alone", "yy", "a"), (3, "Alone", "yy", "b"), rows[5], rows[5], (4, "long " * 30_000 + "the" * 20_000, "en", "a"), (5, "1 2 3", "zz", None)]
    return rows


@pytest.mark.parametrize("counted,block,tile,sent", [(96 << 20, 64, 25_000, 500_000), (40, 2, 50, 0)])
def test_matches_brute_force(spark, monkeypatch, counted, block, tile, sent):
    monkeypatch.setattr(divergence, "COUNTED_BYTES", counted)
    monkeypatch.setattr(divergence, "SENT", sent)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"term": F.lit(1), "chunk": F.lit("x"), "s": F.lit(0), "part": F.lit(0), "v": F.lit(1), "row": F.lit(1)}).repartition(4)
    assert sorted(tuple(r) for r in source_divergence(docs).collect()) == brute(rows)
    got = sorted(tuple(r) for r in source_divergence(docs, least_docs=3, top=2).collect())
    assert got == brute(rows, 3, 2)


def test_rare_chunks_are_counted_by_document(spark):
    # Two spellings of a term in the same documents, and in different ones.
    rows = [(i, "Foo foo, bar" if i < 6 else "bar.", "en", "a") for i in range(12)] + [(20 + i, "baz" if i < 6 else "baz!", "en", "b") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sorted(tuple(r) for r in source_divergence(docs).collect())
    assert got == brute(rows) and {r[3] for r in got if r[2] == "term"} == {"bar", "baz"}


def test_share_of_large_counts(spark):
    rows = [(0, 10**15, 3), (123_456_789_012, 2 * 10**13, 10**7), (10**13, 10**13, 5), (0, 0, 1)]
    df = spark.createDataFrame(rows, "n bigint, total bigint, v bigint")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
