"""Licence scans: TF-IDF cosine to templates, then inheritance down directories.

Every line of a file, and a licence file as a whole, is a segment, compared with
one-sentence statements. Equal segments are scored once. The leading block and the
whole of every text are compared with header notices and licence texts
(``notices``), and SPDX lines are read by their identifiers. A segment that reaches the threshold with a template
must have one of the template's necessary tokens: those whose absence leaves the
rest of the template's length below the threshold. Of such segments, those with
too many foreign tokens are left out by a bound, and the others are scored. A file without a licence of its own takes that of the nearest
ancestor directory in which a file speaks for the directory.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coeval.llm.common import drop_table, small_side
from coeval.llm.notices import COMMON, NOTICES
from coeval.session import RunFolder

THRESHOLD = 0.7

#: Usual statements of the licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _tokens(text: str) -> Counter:
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    return Counter(re.findall(r"[a-z0-9]+", lowered))


def inverse_frequency(templates: dict[str, str]) -> dict[str, float]:
    """Smoothed inverse frequency among the templates of each of their tokens."""
    seen = Counter(t for text in templates.values() for t in _tokens(text))
    return {t: log((1 + len(templates)) / (1 + n)) + 1 for t, n in seen.items()}


def unseen_frequency(templates: dict[str, str]) -> float:
    """Inverse frequency of a token that no template has."""
    return log(1 + len(templates)) + 1


def template_weights(templates: dict[str, str]) -> list[tuple[str, str, float]]:
    """(template, token, weight), every template of length 1."""
    idf, rows = inverse_frequency(templates), []
    for name, text in sorted(templates.items()):
        raw = {t: n * idf[t] for t, n in sorted(_tokens(text).items())}
        size = sqrt(sum(x * x for x in raw.values()))
        rows += [(name, t, x / size) for t, x in raw.items()]
    return rows


def necessary_tokens(templates: dict[str, str], threshold: float) -> list[str]:
    """Tokens of which a segment that reaches the threshold has at least one.

    Of each template the heaviest of its longer words first, until what is left is too short.
    """
    need = set()
    for name in templates:
        rest = {t: w for n, t, w in template_weights(templates) if n == name}
        for token in sorted(rest, key=lambda t: (len(t) < 3, -rest[t], t)):
            # A little below the threshold, for rounding.
            if sqrt(sum(w * w for w in rest.values())) < threshold - 1e-5:
                break
            need.add(token)
            del rest[token]
    return sorted(need)


def _tokens_of(text: Column) -> Column:
    """Runs of ASCII letters and digits as they are written, and empty strings."""
    return F.split(text, "[^A-Za-z0-9]+")


def _likely(run: RunFolder, rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """The distinct segments that may reach the threshold, by a bound on their foreign tokens.

    With s the squared length of a segment's known tokens and m foreign tokens of
    inverse frequency u, the cosine squared is at most s / (s + m u^2).
    """
    listed = [(t, i, v) for i, (t, v) in enumerate(sorted(inverse_frequency(templates).items()))]
    idf = F.broadcast(run.spark.createDataFrame(listed, "token string, t int, idf double"))
    # Only a segment's number goes through the aggregate, not its text.
    number = F.struct(F.xxhash64("segment").alias("a"), F.xxhash64(F.lit(1), "segment").alias("b"))
    # Numbers are made before segments are cut, or they would be made for every word.
    segments = rows.select("segment").distinct().select(number.alias("id"), "segment", F.size(F.array_remove(_tokens_of(F.col("segment")), "")).alias("all"))
    spread = segments.select("id", "all", F.explode_outer(_tokens_of(F.col("segment"))).alias("word"))
    known = spread.select("id", "all", F.lower("word").alias("token")).join(idf, "token")
    counts = known.groupBy("id", "t", "idf").agg(F.count("*").alias("tf"), F.max("all").alias("all"))
    value = F.col("tf") * F.col("idf")
    sums = counts.groupBy("id").agg(F.sum(value * value).alias("s"), (F.max("all") - F.sum("tf")).alias("m"))
    most = (1 - threshold**2) / threshold**2 + 1e-6
    kept = run.table("kept", sums.filter(F.col("m") * unseen_frequency(templates) ** 2 <= most * F.col("s")).select("id"))
    return rows.select("segment", number.alias("id")).join(small_side(kept), "id", "left_semi").select("segment").distinct()


def _scored(segments: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(segment, licence, score): the best template of every distinct segment that reaches the threshold."""
    spark = segments.sparkSession
    weights = F.broadcast(spark.createDataFrame(template_weights(templates), "licence string, token string, weight double"))
    idf = F.broadcast(spark.createDataFrame(sorted(inverse_frequency(templates).items()), "token string, idf double"))
    words = segments.select("segment", F.explode_outer(_tokens_of(F.col("segment"))).alias("t")).filter("t <> ''")
    counted = words.groupBy("segment", F.lower("t").alias("token")).agg(F.count("*").alias("tf"))
    valued = counted.join(idf, "token", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(unseen_frequency(templates))))
    norm = valued.groupBy("segment").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(weights, "token").groupBy("segment", "licence").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scores = dots.join(norm, "segment").select("segment", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("score"), "licence"))
    return scores.withColumn("best", best).filter("best = 1").drop("best")


def block_idf(notices: dict[str, str]) -> dict[str, float]:
    return {t: v for t, v in inverse_frequency(notices).items() if t not in COMMON}


def block_weights(notices: dict[str, str]) -> list[tuple[str, str, float]]:
    """(notice, token, weight) without common words, every notice of length 1."""
    idf, rows = block_idf(notices), []
    for name, text in sorted(notices.items()):
        raw = {t: n * idf[t] for t, n in sorted(_tokens(text).items()) if t in idf}
        size = sqrt(sum(x * x for x in raw.values()))
        rows += [(name, t, x / size) for t, x in raw.items()]
    return rows


def block_needs(notices: dict[str, str], threshold: float) -> list[str]:
    """Tokens of which a block that reaches the threshold has at least one; long ones are asked for first."""
    rests: dict[str, dict[str, float]] = {}
    for name, token, weight in block_weights(notices):
        rests.setdefault(name, {})[token] = weight
    need: set[str] = set()
    for rest in rests.values():
        for token in sorted(rest, key=lambda t: (len(t) < 8, -rest[t], t)):
            if sqrt(sum(w * w for t, w in rest.items() if t not in need)) < threshold - 1e-5:
                break
            need.add(token)
    return sorted(need)


def _blocks(run: RunFolder, files: DataFrame, path: str, text: str, notices: dict[str, str], threshold: float, could_match) -> DataFrame:
    """(MARK, licence, score) of the leading blocks and whole texts that reach the threshold with a notice.

    The leading block ends at the first blank line after a line with letters or
    digits. Only counts of words are shuffled, and after the bound of ``_likely``
    those of foreign words too, no text.
    """
    spark, other = run.spark, unseen_frequency(notices)
    idf = F.broadcast(spark.createDataFrame(sorted(block_idf(notices).items()), "token string, idf double"))
    weights = F.broadcast(spark.createDataFrame(block_weights(notices), "notice string, token string, weight double"))
    need = F.array(*[F.lit(t) for t in block_needs(notices, threshold)])
    mark = F.xxhash64(F.col(path), F.col(text)).alias(MARK)
    chosen = files.select(mark, F.col(text).alias("body")).filter(could_match(F.col("body"), need))
    head = F.regexp_extract("body", r"^(?s)[^A-Za-z0-9]*(.*?)(?:\n[ \t\r]*\n|\z)", 1)
    blocks = chosen.select(MARK, F.explode(F.array(F.struct(F.lit(0).alias("kind"), head.alias("block")), F.struct(F.lit(1).alias("kind"), F.col("body").alias("block")))).alias("b")).select(MARK, "b.*")
    # Tokens go with their numbers from one aggregate a block and word.
    spread = lambda rows: rows.select(MARK, "kind", F.explode_outer(_tokens_of(F.col("block"))).alias("word")).filter("word <> ''").select(MARK, "kind", F.lower("word").alias("token")).filter(~F.col("token").isin(sorted(COMMON)))
    joined = spread(blocks).join(idf, "token", "left")
    counts = joined.groupBy(MARK, "kind", F.when(F.col("idf").isNotNull(), F.col("token")).alias("token"), F.coalesce("idf", F.lit(0.0)).alias("idf")).agg(F.count("*").alias("tf"))
    value = F.col("tf") * F.col("idf")
    sums = counts.groupBy(MARK, "kind").agg(F.sum(value * value).alias("s"), F.sum(F.when(F.col("token").isNull(), F.col("tf")).otherwise(0)).alias("m"))
    most = (1 - threshold**2) / threshold**2 + 1e-6
    kept = run.table("kept-blocks", sums.filter((F.col("s") > 0) & (F.col("m") * other**2 <= most * F.col("s"))).select(MARK, "kind"))
    # Repeated rows are one.
    again = blocks.join(small_side(kept), [MARK, "kind"], "left_semi").dropDuplicates([MARK, "kind"])
    counted = spread(again).groupBy(MARK, "kind", "token").agg(F.count("*").alias("tf")).join(idf, "token", "left")
    valued = counted.withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norm = valued.groupBy(MARK, "kind").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(weights, "token").groupBy(MARK, "kind", "notice").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scores = dots.join(norm, [MARK, "kind"]).select(MARK, F.substring_index("notice", "/", 1).alias("licence"), F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scores.filter(F.col("score") >= threshold)


def _spdx(files: DataFrame, path: str, text: str, licences: list[str]) -> DataFrame:
    """(MARK, licence, score): the listed licences that SPDX lines name, with score 1."""
    ids = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?i)SPDX-License-Identifier:([^\r\n]*)"), F.lit(1))).alias("ids")
    lines = files.filter(F.col(text).rlike("(?i)SPDX-License-Identifier:")).select(F.xxhash64(F.col(path), F.col(text)).alias(MARK), ids)
    # The word after WITH is an exception to a licence.
    named = lines.select(MARK, F.explode(F.split(F.regexp_replace("ids", r"(?i)\bWITH\s+\S+", ""), r"[^A-Za-z0-9.+-]+")).alias("id"))
    plain = F.lower(F.regexp_replace("id", r"(?i)(-only|-or-later|\+)$", "")).alias("id")
    known = F.broadcast(files.sparkSession.createDataFrame([(x.lower(), x) for x in licences], "id string, licence string"))
    return named.select(MARK, plain).join(known, "id").select(MARK, "licence", F.lit(1.0).alias("score"))


def _up(path: Column) -> Column:
    """Directory of a path: what stands before the last slash."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", speaks: Column | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The table with licence, score, origin and given_by, and without the text.

    ``score`` is that of the file's own licence, its best segment's; ``origin``
    is own, inherited or null; ``given_by`` is the path of the file a licence is
    inherited from. Files that ``speaks`` marks give their own licence to their
    directory: by default those named LICENSE, LICENCE, COPYING or NOTICE, with
    any ending, whose whole text is compared with the statements as well. Of
    several in one directory the best score gives it, then the smallest path.
    Notices, texts and SPDX lines count in every file, unless ``templates`` are
    given: then these alone.

    Null and empty texts have no licence of their own, null paths no directory:
    both are passed on. Very long texts and lines are read whole. Repeated rows
    are treated alike, one row each. An empty table gives no rows. Other columns
    are passed on; those named like the new ones are replaced. Of licences with
    equal scores the first by name is taken.
    """
    listed = templates is None
    templates = TEMPLATES if listed else templates
    if not 0 < threshold <= 1 or not templates:
        raise ValueError("the threshold must be in (0, 1], and there must be templates")
    run = RunFolder(files.sparkSession)
    named = F.col(path).rlike(r"(^|/)(?i:LICEN[SC]E|COPYING|NOTICE)([.-][^/]*)?$")
    known = speaks is not None
    tokens = F.array(*[F.lit(t) for t in necessary_tokens(templates, threshold)])
    # The two foreign characters that lower to ASCII letters must not join words.
    plain = lambda s: F.replace(F.replace(s, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))
    could_match = lambda s, need=tokens: F.arrays_overlap(F.split(F.lower(plain(s)), "[^a-z0-9]+"), need)
    lines = F.split(F.col(text), "\n")
    pieces = lines if known else F.when(named, F.concat(lines, F.array(F.col(text)))).otherwise(lines)
    made = ("licence", "score", "origin", "given_by")
    carried = [c for c in files.columns if c != text]
    # A text without a needed token is settled before it is cut into lines.
    could = F.filter(F.when(could_match(F.col(text)), pieces), lambda s: could_match(s))
    rows = files.select(F.xxhash64(F.col(path), F.col(text)).alias(MARK), F.col(path).alias("p"), F.coalesce(speaks if known else named, F.lit(False)).alias("speaks"), F.explode_outer(could).alias("segment")).filter("segment is not null")
    rows = run.table("rows", rows)
    likely = run.table("likely", _likely(run, rows, templates, threshold))
    best = run.table("best", _scored(likely, templates, threshold))
    first = F.min(F.struct((-F.col("score")).alias("below"), "licence", "p", "speaks", "score"))
    found = rows.join(best, "segment").select(MARK, "licence", "p", "speaks", "score")
    if listed:
        more = run.table("more", _blocks(run, files, path, text, NOTICES, threshold, could_match).unionAll(_spdx(files, path, text, sorted(TEMPLATES))))
        facts = files.select(F.xxhash64(F.col(path), F.col(text)).alias(MARK), F.col(path).alias("p"), F.coalesce(speaks if known else named, F.lit(False)).alias("speaks"))
        more = small_side(more.groupBy(MARK).agg(F.min(F.struct((-F.col("score")).alias("below"), "licence", "score")).alias("m")))
        found = found.unionAll(facts.join(more, MARK).select(MARK, "m.licence", "p", "speaks", "m.score"))
    own = found.groupBy(MARK).agg(first.alias("own")).select(MARK, "own.licence", "own.score", "own.p", "own.speaks")
    own = run.table("own", own)

    speaking = own.filter("speaks and p is not null").withColumn("dir", _up(F.col("p")))
    # The best of a directory by one aggregate: a directory may hold any number of files.
    top = speaking.groupBy("dir").agg(F.max("score").alias("score")).join(speaking, ["dir", "score"]).groupBy("dir").agg(F.min(F.struct("p", "licence")).alias("g"))
    givers = run.table("givers", top.select("dir", F.col("g.licence").alias("given"), F.col("g.p").alias("given_by")))
    folders = files.filter(F.col(path).isNotNull()).select(_up(F.col(path)).alias("folder")).distinct()
    steps = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("dir", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(givers, "dir").groupBy("folder").agg(F.max_by(F.struct("given", "given_by"), "depth").alias("near"))
    nearest = run.table("nearest", nearest.select("folder", "near.*"))

    # The user's columns travel as one, so none can clash.
    marked = files.select(F.struct(*carried).alias("row"), F.xxhash64(F.col(path), F.col(text)).alias(MARK), _up(F.col(path)).alias(FOLDER))
    mine = own.select(MARK, F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    full = marked.join(mine, MARK, "left").join(nearest.withColumnRenamed("folder", FOLDER), FOLDER, "left")
    inherits = F.col("own_licence").isNull() & F.col("given").isNotNull()
    result = full.select(
        *[F.col(f"row.`{c}`") for c in carried if c not in made],
        F.coalesce("own_licence", "given").alias("licence"),
        F.col("own_score").alias("score"),
        F.when(F.col("own_licence").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("given_by")).alias("given_by"),
    )
    for step in ("rows", "kept", "likely", "best", "givers", "kept-blocks", "more"):
        drop_table(run, step)
    return result


#: Columns that carry a row's key and directory; dropped again.
MARK, FOLDER = "__coeval_file_key", "__coeval_folder"
