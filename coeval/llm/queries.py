"""One query per operator, over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coeval.llm.common import read
from coeval.llm.decontam import benchmark_hits, words_of
from coeval.llm.decontam import row_key as leak_key
from coeval.llm.divergence import source_divergence
from coeval.llm.infill import fill_in_middle, restored
from coeval.llm.jaccard import jaccard_classes
from coeval.llm.languages import fit_languages, languages
from coeval.llm.languages import is_held_out as is_unlearned
from coeval.llm.licences import TEMPLATES, THRESHOLD, inverse_frequency, scan_licences, template_weights, unseen_frequency
from coeval.llm.lines import repeated_lines
from coeval.llm.mixing import mixed
from coeval.llm.quality import fit_quality, is_held_out, quality_scores
from coeval.llm.suffix import repeated_spans, row_key
from coeval.llm.tokens import token_counts
from coeval.llm.topk import top_k
from coeval.llm.urls import filter_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@_register("op1_exact_topk_search", TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_register("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


@_register("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    size, text = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"), F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", row_key("doc_id", "text").alias("key"), size.alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    cut = repeated_spans(docs).select("key", total.alias("removed"), F.size("spans").cast("bigint").alias("spans"), F.sha2("kept", 256).alias("kept"))
    return plain.join(cut, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )


#: Fixed values of the query: rules with their verdicts.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@_register("op4_url_filters")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


@_register("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    weights = fit_quality(docs, labels.filter(~is_held_out("doc_id")))
    scores = quality_scores(docs, weights)
    return scores.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_register("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("*", (F.col("n_tokens") > 2048).alias("over_limit"))


@_register("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)
), ks AS (SELECT DISTINCT k FROM wins),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
hits AS (
  SELECT doc_id, s, ks.k AS k, item_id FROM p JOIN ks ON s + ks.k - 1 <= len(w)
  JOIN wins ON wins.k = ks.k AND wins.g = array_to_string(w[s:s + ks.k - 1], ' ')
), n AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS at FROM hits) GROUP BY 1
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@_register("op9_benchmark_decontamination", LEAKS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, read(spark, sf_dir, "benchmark"), nameless=True)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    found = found.select("key", hit.alias("hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("bigint").alias("found"), F.array_join("items", ",").alias("names"))
    words = F.size(words_of(F.col("text"))).cast("bigint")
    plain = docs.select("doc_id", leak_key("doc_id", "text").alias("key"), words.alias("n_words"))
    return plain.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _op7_sql() -> str:
    weights = ", ".join(f"('{name}', '{token}', {weight!r})" for name, token, weight in template_weights(TEMPLATES))
    known = ", ".join(f"('{token}', {value!r})" for token, value in sorted(inverse_frequency(TEMPLATES).items()))
    other = unseen_frequency(TEMPLATES)
    return rf"""
WITH weights(licence, token, w) AS (VALUES {weights}), idf(token, v) AS (VALUES {known}),
files AS (
  SELECT doc_id, coalesce(source, '') || CASE WHEN lang = 'en' THEN '' ELSE '/' || coalesce(lang, '') END AS dir, string_split(text, chr(10)) AS lines FROM documents
), segments AS (SELECT DISTINCT unnest(lines) AS line FROM files),
tf AS (
  SELECT line, token, count(*) AS tf FROM (
    SELECT line, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS token FROM segments
  ) GROUP BY ALL
), norms AS (SELECT line, sqrt(sum((tf * coalesce(v, {other!r})) ** 2)) AS norm FROM tf LEFT JOIN idf USING (token) GROUP BY 1),
scores AS (
  SELECT line, licence, round(sum(tf * v * w) / any_value(norm), 6) AS score FROM tf JOIN idf USING (token) JOIN weights USING (token) JOIN norms USING (line) GROUP BY ALL
), best AS (
  SELECT line, arg_max(licence, (score, -rank)) AS licence, max(score) AS score
  FROM (SELECT *, dense_rank() OVER (ORDER BY licence) AS rank FROM scores WHERE score >= {THRESHOLD!r}) GROUP BY 1
), own AS (
  SELECT doc_id, dir, licence, score FROM (
    SELECT doc_id, dir, licence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r
    FROM (SELECT doc_id, dir, unnest(lines) AS line FROM files) JOIN best USING (line)
  ) WHERE r = 1
), dirs AS (
  SELECT dir, licence, doc_id AS giver FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, dir || '/' || doc_id) AS r FROM own) WHERE r = 1
), near AS (
  SELECT f.doc_id, d.licence, d.giver, row_number() OVER (PARTITION BY f.doc_id ORDER BY len(d.dir) DESC) AS r
  FROM files f JOIN dirs d ON d.dir = f.dir OR starts_with(f.dir, d.dir || '/')
)
SELECT f.doc_id, coalesce(o.licence, n.licence) AS licence, o.score, CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.licence IS NULL THEN n.giver END AS giver
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN (SELECT * FROM near WHERE r = 1) n USING (doc_id)
"""


@_register("op7_license_scans", _op7_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents have no file names: English lies in a source's own directory, other languages below it,
    # and any document with a licence speaks for its directory.
    folder = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("/"), F.coalesce("lang", F.lit("")))))
    files = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat(folder, F.lit("/"), F.col("doc_id")).alias("path"))
    found = scan_licences(files, speaks=F.lit(True))
    last = F.element_at(F.split("given_by", "/"), -1).cast("bigint")
    return found.select("doc_id", "licence", "score", "origin", last.alias("giver"))


INFILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, least(a, b) AS i, greatest(a, b) AS j FROM k
), p AS (
  SELECT *, substring(t, 1, i) AS prefix, substring(t, i + 1, j - i) AS middle, substring(t, j + 1, n - j) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@_register("op11_fill_in_middle", INFILL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix").alias("prefix_chars"),
        F.col("middle").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(back).alias("restored_sha256"),
    )


@_register("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~is_unlearned("doc_id")))
    return languages(docs, model).select("doc_id", is_unlearned("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM (SELECT row, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
h AS MATERIALIZED (SELECT lang, source, term, t.n::HUGEINT AS n FROM t JOIN kept USING (lang, term)),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM h GROUP BY ALL),
grid AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS count,
    1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM grid WHERE count > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
"""


@_register("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))
