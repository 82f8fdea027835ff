import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import coeval.llm.tokens as tokens
from coeval.llm.tokens import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(2)
    alphabet = "abcdeXYZ'\"!?.,-0123456789 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0éÉßİıſςΣé한漢字🙂🏽\u200d\u2003\u2028\ufeff<|>"
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows += ["", None, " ", "it's I'LL don't", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "<|END|> <|endoftext|", "x" * 5000, "word " * 3000, "ΑΣ ΟΔΟΣ", "e\u0301 e \u0301"]
    return list(enumerate(rows)) + [(3, rows[3]), (None, "null id")]


def brute(rows):
    library = Tokenizer.from_file(PATH)
    return sorted(((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows), key=str)


@pytest.mark.parametrize("frequent,cached", [(32_768, 250_000), (1, 1)])
def test_matches_the_library(spark, monkeypatch, frequent, cached):
    monkeypatch.setattr(tokens, "FREQUENT", frequent)
    monkeypatch.setattr(tokens, "CACHED", cached)
    df = spark.createDataFrame(texts(), "doc_id bigint, text string").withColumn("row", F.lit(1)).withColumn("n_bytes", F.lit(2)).repartition(3)
    got = sorted((tuple(r) for r in token_counts(df, PATH).collect()), key=str)
    assert got == brute(texts())


def test_tokenizer_that_keeps_space_is_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        token_counts(df, public_tokenizers.path("byte_bpe_50k.json"))


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
