"""URL filters: host and path rules, and boosted trees where no rule fits.

The trees (Spark's gradient-boosted trees) see lexical features only: lengths,
depth, digit ratio, character entropy, parameter counts, and how often labelled
URLs with the same host suffix are blocked. Labelled URLs are those that a rule
decides, unless labels are given.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coeval.llm.common import lower_ascii, small_side
from coeval.session import RunFolder

#: Most labelled URLs that a fit uses; trees and their depth.
SAMPLE_ROWS, TREES, DEPTH = 20_000, 12, 3

LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "fragment", "hyphens", "suffix_rate", "suffix_seen", "domain_rate", "domain_seen")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_replace(F.substr(url, F.locate("://", url) + 3), r"[/?#](?s:.)*$", "")
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, lower_ascii(rest)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.regexp_replace(F.substr(url, F.locate("://", url) + 3), r"[?#](?s:.)*$", "")
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_replace(rest, r"^[^/]+", "")).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; ``rules`` are (verdict, rule).

    A rule is a host and a path. It fits the host and its subdomains where the
    path starts with the rule's. Of equally long rules the smallest wins.
    """
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        result = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def _entropy(text: Column) -> Column:
    """Bits per character, from the count of every distinct character."""
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    spent = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s + c * F.log2(c))
    return F.when(n > 0, F.log2(n) - spent / n).otherwise(F.lit(0.0))


def _lexical(rows: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.regexp_count(path, F.lit(r"/[^/]")).cast("double").alias("depth"),
        F.regexp_count(host, F.lit(r"[^.]+")).cast("double").alias("labels"),
        (F.regexp_count(url, F.lit(r"[0-9]")) / F.greatest(F.length(url), F.lit(1))).cast("double").alias("digits"),
        _entropy(url).alias("entropy"),
        F.regexp_count(query, F.lit(r"[^&]+")).cast("double").alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.regexp_count(host, F.lit("-")).cast("double").alias("hyphens"),
        F.substring_index(host, ".", -1).alias("suffix"),
        F.substring_index(host, ".", -2).alias("domain"),
    )


def _rates(known: DataFrame, key: str) -> DataFrame:
    """How many labelled URLs a host suffix has, and how many of them are blocked."""
    return known.groupBy(key).agg(F.count("*").cast("double").alias(f"{key}_all"), F.sum("label").alias(f"{key}_blocked"))


def _with_rates(rows: DataFrame, key: str, counts: DataFrame, learned: bool) -> DataFrame:
    """Adds a suffix's labelled URLs, as a logarithm, and their smoothed share of blocks; a URL learned from is not counted for itself."""
    own, blocked = (F.lit(1.0), F.col("label")) if learned else (F.lit(0.0), F.lit(0.0))
    seen = F.greatest(F.coalesce(f"{key}_all", F.lit(0.0)) - own, F.lit(0.0))
    rate = (F.greatest(F.coalesce(f"{key}_blocked", F.lit(0.0)) - blocked, F.lit(0.0)) + 1) / (seen + 2)
    return rows.join(counts, key, "left").withColumns({f"{key}_seen": F.log1p(seen), f"{key}_rate": rate}).drop(f"{key}_all", f"{key}_blocked")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    ``verdict`` is the longest fitting rule's, else ``block`` where the trees
    give blocking at least even odds, else ``allow``. ``score`` is that
    probability, null where a rule fits. Trees learn from at most SAMPLE_ROWS
    rows, picked by a hash of the URL; ``labels`` (url, blocked 0/1) replaces
    the rules' verdicts as labels. Suffix statistics count all labelled rows but the
    one that is learned from. With fewer
    than two kinds of label there is nothing to learn and the rest is allowed.

    Null URLs and those without ``://`` have an empty host and path. Very long
    URLs are read whole. Repeated rows are judged alike, one row each; null ids
    are passed on. An empty table gives no rows; other columns are not read.
    """
    run = RunFolder(pages.sparkSession)
    split = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        known = ruled.filter("fit is not null").withColumn("label", (F.col("fit.verdict") == "block").cast("double"))
    else:
        known = labels.select("url", F.col("blocked").cast("double").alias("label")).filter("label in (0, 1)")
        known = known.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    suffixes = run.table("suffixes", _rates(known.withColumn("suffix", F.substring_index("host", ".", -1)), "suffix"))
    domains = run.table("domains", _rates(known.withColumn("domain", F.substring_index("host", ".", -2)), "domain"))

    def described(rows: DataFrame, learned: bool = False) -> DataFrame:
        return _with_rates(_with_rates(_lexical(rows), "suffix", small_side(suffixes), learned), "domain", small_side(domains), learned)

    sample = known.orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE_ROWS).select("url", "host", "path", "label")
    train = run.table("train", described(sample, True).select("label", *LEXICAL))
    kinds = train.agg(F.count_distinct("label")).first()[0]
    open_rows = described(ruled) if kinds > 1 else ruled
    if kinds > 1:
        gather = VectorAssembler(inputCols=list(LEXICAL), outputCol="features")
        model = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(gather.transform(train.coalesce(4)))
        scored = model.transform(gather.transform(open_rows))
        score = vector_to_array("probability")[1]
    else:
        scored, score = open_rows, F.lit(0.0)
    score = F.when(F.col("fit").isNull(), score)
    return scored.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
