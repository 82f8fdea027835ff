import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import coeval.llm.languages as languages
from coeval.llm.languages import codewords, decode, fit_languages, is_held_out, slots_of


def corpus(names, each=90, seed=4):
    """Texts of invented words, each language with syllables of its own."""
    rng = random.Random(seed)
    sounds = {x: [rng.choice("bcdfghklmnprst") + rng.choice("aeiouéö") + rng.choice(["", "n", "s"]) for _ in range(14)] for x in names}
    word = lambda x: "".join(rng.choice(sounds[x]) for _ in range(rng.randint(1, 4)))
    rows = [(x, " ".join(word(x) for _ in range(rng.randint(8, 60)))) for x in names for _ in range(each)]
    rng.shuffle(rows)
    return [(i, text, lang) for i, (lang, text) in enumerate(rows)]


@pytest.mark.parametrize("count", [2, 4, 9])
def test_held_out_accuracy(spark, monkeypatch, count):
    monkeypatch.setattr(languages, "HELD", 3)
    rows = corpus([f"l{k}" for k in range(count)])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"row": F.lit(1), "number": F.lit("x"), "score": F.lit(0), "slot": F.lit(0)}).repartition(3)
    model = fit_languages(docs.filter(~is_held_out("doc_id")))
    assert model[0] == sorted({r[2] for r in rows})
    got = {r["doc_id"]: r for r in languages.languages(docs, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["lang_pred"] == x for i, x in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = corpus(["aa", "bb"], 20)
    odd = [(None, rows[0][1], rows[0][2]), (1000, None, "aa"), (1001, "", "aa"), (1002, "12 ½ Ⅷ ² !?", "bb"), (1003, rows[1][1] * 3000, rows[1][2]), (1004, "漢", None), rows[2], rows[2]]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    model = fit_languages(docs)
    got = [tuple(r) for r in languages.languages(docs, model).collect()]
    assert len(got) == len(rows) + len(odd)
    by = {r[0]: r[1:] for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0, True)
    assert by[None][0] == rows[0][2] and by[1003][0] == rows[1][2] and by[1004][0] in ("aa", "bb")
    empty = docs.limit(0)
    assert languages.languages(empty, model).collect() == []
    nothing = fit_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r)[1:] for r in languages.languages(docs, nothing).collect()} == {("und", 0.0, True)}
    one = fit_languages(docs.withColumn("lang", F.lit("aa")))
    assert {r["lang_pred"] for r in languages.languages(docs.filter("doc_id < 40"), one).collect()} == {"aa"}
    assert fit_languages(empty)[0] == []


def test_weights_are_log_ratios_of_mean_shares(spark):
    rows = corpus(["aa", "bb", "cc"], 15)
    names, weights, code, _ = fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts = np.array([np.bincount(np.concatenate([slots_of(t) for _, t, x in rows if x == name]), minlength=languages.SLOTS) for name in names])
    share = counts / counts.sum(axis=1, keepdims=True)
    base = languages.SMOOTHING / counts.sum(axis=1).mean()
    for k in range(code.shape[1]):
        want = np.log(share[code[:, k] > 0].mean(axis=0) + base) - np.log(share[code[:, k] < 0].mean(axis=0) + base)
        assert np.allclose(weights[:, k], want, atol=1e-5)


def test_codes_correct_errors():
    for count in (2, 3, 4, 5, 6, 20, 150):
        code = codewords(count).astype(int)
        far = min((code[i] != code[j]).sum() for i in range(count) for j in range(i))
        assert far >= (1 << max(count - 2, 0) if count <= 5 else code.shape[1] / 5)
        assert all(len(set(code[:, k])) == 2 for k in range(code.shape[1]))
        for row in range(count):
            found = 3.0 * code[row]
            found[: (far - 1) // 2] *= -1
            assert decode(found, code, np.ones(code.shape))[0] == row
