import random

import pytest
from pyspark.sql import functions as F

from coeval.llm.urls import filter_urls, host_of, path_of

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host, rest[end:stop] if stop > end else ""


def rule(host, path):
    best = None
    for verdict, text in RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best


ODD = [None, "", "no scheme", "http://", "http://com", "HTTP://COM/", "a://b://c/d", "x://Sub.Example.COM/en/?q#f", "x://www.example.com/en/1", "x://notexample.com/en/1", "x://net/es/", "x://a.net/es", "x://a.net?u=/es/", "x://É.net/fr/ü", "x://h#/en/", "x://a.com/\n/en?b\nc", "x://" + "a" * 5000 + ".com/en/", "http://a\0\0b.com/en/\0x", "x://\0\0/\0\0"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(ODD)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, RULES).collect()}
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        host, path = cut(url)
        fit = rule(host, path)
        assert got[i][:3] == (host, path, fit and fit[0])
        assert got[i][3] == fit[1] if fit else got[i][3] in ("allow", "block")
    split = df.select("page_id", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert all((r["h"], r["p"]) == cut(ODD[r["page_id"]]) for r in split)


def test_trees_learn_from_labels(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(900):
        bad = rng.random() < 0.5
        url = f"http://{word(6)}.org/" + (f"{rng.randrange(10**9)}/{rng.randrange(10**9)}?a={word(3)}&b={word(2)}" if bad else f"{word(5)}/{word(4)}")
        rows.append((i, url, int(bad)))
    df = spark.createDataFrame(rows, "page_id bigint, url string, blocked int")
    labels = df.filter("page_id < 600").select("url", "blocked")
    held = {r["page_id"]: r["verdict"] == "block" for r in filter_urls(df.drop("blocked"), RULES, labels=labels).collect()}
    right = sum(held[i] == bool(b) for i, _, b in rows if i >= 600)
    assert right >= 290


@pytest.mark.parametrize("urls", [[], ["x://a.com/"], [None, None]])
def test_nothing_to_learn(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("label", F.lit("y"))
    got = filter_urls(df, RULES).collect()
    assert [r["verdict"] for r in got] == ["allow"] * len(urls)
