"""Exact n-gram Jaccard join by grouped prefixes, and the classes it links.

A document's set is its distinct word shingles as 64-bit hashes. A link needs
``100 * shared >= percent * union``, so each end must share at least
``alpha(n) = ceil(percent * n / 100)`` of its own n shingles.

1. One scan hashes the shingles. Of each set the ``n - alpha + l`` smallest
   hashes are sent out, l = ceil(alpha / 5): linked sets have at least
   l(alpha(n)) of them in common. Documents that share fewer with anyone else
   have no links and end here. Within a batch a shingle of several documents is
   settled on the spot and sent once, so a phrase found everywhere stays cheap.
2. Equal sets become one class. Shingles of the remaining classes are ordered by
   rarity; a class that shares less than alpha with all others ends here.
3. Classes with the same size and prefix form one group. Prefix tokens pair
   groups under length and positional bounds; members are expanded and verified.

Only connectivity is asked for, so pairs whose ends are already connected are
never built: groups are first compared with one central pivot each, and what a
prefix token then still holds in different components is compared in full.
"""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.llm.common import M1, M2, WordHashes, bites, drop_table, part_count, scramble, ship_by_value, short_batches, small_side
from coeval.llm.components import components
from coeval.session import RunFolder

#: Text that a part of the shuffled names stands for, in MB; a part is sorted in one task's memory.
PART_MB = 8
#: Rounds with pivots before the rest is compared; ratio of the sizes in a band.
STAR_ROUNDS, BAND = 2, 1.1


def shingle_set(text: bytes | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text's UTF-8 bytes.

    A-Z is lower-cased and words are split at ASCII white space. A text with
    fewer words than ``width`` is one shingle; null or no words give none.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(width, len(found))
    count = len(found) - size + 1
    rolled = np.full(count, size, np.uint64)
    for j in range(size):
        rolled = scramble(rolled * M1 + hashes[j : j + count])
    return np.unique(rolled)


def _needs(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least overlap, sample size, and sampled hashes that must be shared, for set sizes n."""
    alpha = -(-percent * n // 100)
    return alpha, n - alpha + -(-alpha // 5), -(-(-(-percent * alpha // 100)) // 5)


def _sampler(width: int, percent: int, parts: int):
    """Arrow batches of (id, text) to rows of set facts and of packed shingles by part."""

    def run(batches):
        import hashlib

        words = WordHashes()
        for batch in bites(batches, 1):
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            sets = [shingle_set(t.as_py(), width, words) for t in batch.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            alpha, take, need = _needs(n, percent)
            take = np.where(n > 0, np.minimum(take, n), 0)
            flat = np.concatenate([np.empty(0, np.uint64), *(s[:k] for s, k in zip(sets, take))])
            owner = np.repeat(np.arange(len(n)), take)
            names, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
            shared = counts[index] > 1
            credit = np.bincount(owner[shared], minlength=len(n))
            yield pa.record_batch(
                {
                    "part": pa.array(ids % parts, pa.int32()),
                    "doc": pa.array(ids, pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "need": pa.array(need, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "credit": pa.array(credit, pa.int64()),
                    "names": pa.nulls(len(n), pa.binary()),
                    "docs": pa.nulls(len(n), pa.binary()),
                }
            )
            # Shingles of one document of the batch go out with it, others once and alone.
            single = np.nonzero(~shared)[0]
            single = single[np.argsort(flat[single], kind="stable")]
            several = names[counts > 1]
            edges = [np.uint64((k << 64) // parts) for k in range(1, parts)]
            cut_a = [0, *np.searchsorted(flat[single], edges), len(single)]
            cut_b = [0, *np.searchsorted(several, edges), len(several)]
            out = {"part": [], "names": [], "docs": []}
            for k in range(parts):
                mine, marks = single[cut_a[k] : cut_a[k + 1]], several[cut_b[k] : cut_b[k + 1]]
                if len(mine) or len(marks):
                    out["part"].append(k)
                    out["names"].append(flat[mine].tobytes() + marks.tobytes())
                    out["docs"].append(ids[owner[mine]].tobytes())
            rows = len(out["part"])
            blank = pa.nulls(rows, pa.int64())
            yield pa.record_batch(
                {
                    "part": pa.array(out["part"], pa.int32()),
                    "doc": blank,
                    "n": blank,
                    "need": blank,
                    "digest": pa.nulls(rows, pa.binary()),
                    "credit": blank,
                    "names": pa.array(out["names"], pa.binary()),
                    "docs": pa.array(out["docs"], pa.binary()),
                }
            )

    return run


FACTS = "doc bigint, n bigint, need bigint, digest binary, credit bigint"
CREDITS = f"bucket int, {FACTS}, docs binary, credits binary"


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table.column(name) if x.is_valid)])


def _crediting(parts: int):
    """Give documents a credit for every sampled shingle that another batch also holds, one row a bucket."""

    def run(table: pa.Table) -> pa.Table:
        names, lone = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for a, b in zip(table.column("names"), table.column("docs")):
            if a.is_valid:
                names.append(np.frombuffer(a.as_py(), np.uint64))
                lone.append(np.arange(len(names[-1])) < len(b.as_py()) // 8)
        names, lone, docs = np.concatenate(names), np.concatenate(lone), _column(table, "docs", np.int64)
        order = np.argsort(names)
        same = names[order][1:] == names[order][:-1]
        shared = np.zeros(len(names), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        owners, credit = np.unique(docs[shared[lone]], return_counts=True)
        bucket = owners % parts
        by = np.argsort(bucket, kind="stable")
        keys, cuts = np.unique(bucket[by], return_index=True)
        ends = [*cuts[1:], len(by)]
        facts = table.filter(table.column("doc").is_valid()).select(["part", "doc", "n", "need", "digest", "credit"])
        facts = facts.rename_columns(["bucket", *facts.column_names[1:]])
        blank = pa.nulls(len(facts), pa.binary())
        facts = facts.append_column("docs", blank).append_column("credits", blank)
        none = pa.nulls(len(keys), pa.int64())
        more = pa.table(
            {
                "bucket": pa.array(keys, pa.int32()),
                "doc": none,
                "n": none,
                "need": none,
                "digest": pa.nulls(len(keys), pa.binary()),
                "credit": none,
                "docs": pa.array([owners[by[a:b]].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                "credits": pa.array([credit[by[a:b]].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            }
        )
        return pa.concat_tables([facts, more])

    return run


def _totals():
    """Add a bucket's packed credits to its documents."""

    def run(table: pa.Table) -> pa.Table:
        docs, credits = _column(table, "docs", np.int64), _column(table, "credits", np.int64)
        keys, index = np.unique(docs, return_inverse=True)
        sums = np.bincount(index, credits, len(keys)).astype(np.int64)
        facts = table.filter(table.column("doc").is_valid()).select(["doc", "n", "need", "digest", "credit"])
        mine = facts.column("doc").to_numpy()
        at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
        got = np.where(keys[at] == mine, sums[at], 0) if len(keys) else np.zeros(len(mine), np.int64)
        return facts.set_column(4, "credit", pa.array(facts.column("credit").to_numpy() + got, pa.int64()))

    return run


def _setter(width: int):
    """Arrow batches of (id, text, digest) to the sets of the texts with that digest."""

    def run(batches):
        import hashlib

        words = WordHashes()
        for batch in bites(batches, 1):
            sets = [shingle_set(t.as_py(), width, words) for t in batch.column(1)]
            mine = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d.as_py() for s, d in zip(sets, batch.column(2))]
            kept = [s.view(np.int64) for s, m in zip(sets, mine) if m]
            yield pa.record_batch({"rep": batch.column(0).filter(pa.array(mine, pa.bool_())), "tokens": pa.array(kept, pa.list_(pa.int64()))})

    return run


def _sizer(width: int):
    """Arrow batches of texts to the sizes of their sets."""

    def run(batches):
        words = WordHashes()
        for batch in bites(batches, 0):
            yield pa.record_batch({"n": pa.array([len(shingle_set(t.as_py(), width, words)) for t in batch.column(0)], pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", "na", "nb", shared.alias("o"))
        .filter(F.col("o") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o")))
        .select("a", "b")
    )


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, lone, prefix, middle): the shared tokens among a set's rarest, after ``lone`` unshared ones.

    ``middle`` is the mean number of sets that hold a token of the set: among
    near copies of one text it is highest for what they have in common.
    """
    tokens = sets.select("rep", "n", F.explode("tokens").alias("token"))
    count = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = tokens.join(count, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    alpha = F.expr(f"({percent} * n + 99) div 100")
    return (
        ordered.withColumn("lone", F.col("n") - F.size("ts"))
        .filter(F.size("ts") >= alpha)
        .withColumn("middle", (F.aggregate("ts.df", F.lit(0).cast("bigint"), lambda s, x: s + x) + F.col("lone")) / F.col("n"))
        .select("rep", "n", "lone", "middle", F.slice("ts.token", F.lit(1), (F.col("n") - alpha + 1 - F.col("lone")).cast("int")).alias("prefix"))
    )


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Set size and connected class of every document.

    Two documents link when their shingle sets' Jaccard similarity is at least
    ``percent`` / 100. Returns (id, n_shingles bigint, component_id bigint), one
    row per id and one per row without, the component being the smallest id reachable by links. Sets are
    compared by 64-bit hashes.

    Nulls: a null text or one without words has no shingles and its own class;
    a row with a null id has its own set size and a null class, and is linked
    with nothing. Very long texts are hashed whole. Rows that repeat an
    id count once: the smallest of their sets' digests stands for the id. An
    empty table gives no rows; other columns are not read.
    """
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width at least 1")
    run = RunFolder(docs.sparkSession)
    short_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.col(text).cast("binary").alias("text")).filter("doc is not null")
    parts = part_count(plain, "text", PART_MB)
    packed = plain.mapInArrow(_sampler(width, percent, parts), f"part int, {FACTS}, names binary, docs binary")
    credited = packed.groupBy("part").applyInArrow(_crediting(parts), CREDITS).groupBy("bucket").applyInArrow(_totals(), FACTS)
    facts = run.table(
        "facts",
        credited.groupBy("doc").agg(
            F.min(F.when(F.col("digest").isNotNull(), F.struct("digest", "n", "need"))).alias("f"),
            F.max("credit").alias("credit"),
            F.count("digest").alias("rows"),
        )
        .select("doc", "f.digest", "f.n", "f.need", "credit", "rows"),
    )
    classes = run.table(
        "classes",
        facts.filter("n > 0")
        .groupBy("digest")
        .agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.max(F.expr("credit >= need")).alias("open"), F.min_by("rows", "doc").alias("rows")),
    )
    reps = run.table("reps", classes.filter("open").select(F.col("rep").alias("doc"), "digest", "rows"))

    def sets_of(some: DataFrame) -> DataFrame:
        texts = plain.join(small_side(some.select("doc", "digest")), "doc").select("doc", "text", "digest")
        return texts.mapInArrow(_setter(width), "rep bigint, tokens array<bigint>").withColumn("n", F.size("tokens").cast("bigint"))

    # A representative has one set; only of those with several rows are sets shuffled for that.
    made, several = sets_of(reps.filter("rows = 1")), reps.filter("rows > 1")
    if not several.isEmpty():
        made = made.unionAll(sets_of(several).dropDuplicates(["rep"]))
    sets = run.table("sets", made)
    label = _link(run, sets, percent)
    joined = (
        facts.join(classes.select("digest", "rep"), "digest", "left")
        .join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .select(
            F.col("doc").alias(id_column),
            F.col("n").alias("n_shingles"),
            F.coalesce("label", "rep", "doc").alias("component_id"),
        )
    )
    # Rows without an id have no name to link by: a row each, with the size of its set.
    bare = docs.filter(F.col(id_column).isNull()).select(F.col(text).cast("binary").alias("text"))
    sizes = bare.mapInArrow(_sizer(width), "n bigint")
    joined = joined.unionAll(sizes.select(F.lit(None).cast("bigint"), "n", F.lit(None).cast("bigint")))
    result = run.table("result", joined)
    for step in ("facts", "classes", "reps", "sets"):
        drop_table(run, step)
    return result


def _link(run: RunFolder, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the classes that have links."""
    prefixes = run.table("prefixes", _prefixes(sets, percent))
    # A token of one class only cannot recur in another prefix, so such a prefix is a group by itself.
    key = ["n", "lone", "prefix", F.when(F.col("lone") > 0, F.col("rep")).alias("own")]
    groups = run.table("groups", prefixes.groupBy(*key).agg(F.min("rep").alias("gid"), F.max("middle").alias("middle")))
    members = run.table(
        "members",
        prefixes.filter("lone = 0").join(groups.filter("lone = 0").select("n", "prefix", "gid"), ["n", "prefix"]).select("gid", "rep", "n")
        .unionAll(prefixes.filter("lone > 0").select(F.col("rep").alias("gid"), "rep", "n")),
    )
    tokens = groups.select("gid", "n", "middle", "lone", F.posexplode("prefix").alias("pos", "token"))
    postings = run.table("postings", tokens.select("token", "gid", "n", "middle", (F.col("pos") + F.col("lone")).alias("pos"), F.floor(F.log("n") / F.log(F.lit(BAND))).alias("band")))
    sets = run.table("live", sets.join(prefixes.select("rep"), "rep", "left_semi"))

    # Round one: members against their group, groups against the pivot most of their tokens name.
    wide = postings.select("token", "gid", "middle", F.floor(F.log("n") / F.log(F.lit(max(100 / percent, BAND)))).alias("wide"))
    pivots = wide.groupBy("token", "wide").agg(F.max(F.struct("middle", "gid")).alias("p"), F.count("*").alias("held")).filter("held > 1")
    named = wide.join(pivots, ["token", "wide"]).select(F.col("gid").alias("b"), F.col("p.gid").alias("a"))
    stars = members.filter("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b")).unionAll(_favourite(named))
    found = [run.table("links-0", _verified(stars, sets, percent))]
    label = components(run, "cc-0", found[0])

    for i in range(1, STAR_ROUNDS + 1):
        units = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        units = run.table(f"units-{i}", units)
        open_units = run.table(f"open-{i}", _open(postings, units, percent))
        if open_units.isEmpty():
            break
        if i < STAR_ROUNDS:
            pivots = open_units.groupBy("token", "low", "high").agg(F.max(F.struct("middle", "rep", "label")).alias("p"))
            named = open_units.join(pivots, ["token", "low", "high"]).filter("label <> p.label").select(F.col("rep").alias("b"), F.col("p.rep").alias("a"))
            pairs = _favourite(named)
        else:
            pairs = _rest(open_units, units, percent)
        found.append(run.table(f"links-{i}", _verified(pairs, sets, percent)))
        label = components(run, f"cc-{i}", reduce(DataFrame.unionAll, found))
    return label


def _favourite(named: DataFrame) -> DataFrame:
    """Of the pivots ``a`` named for every ``b``, the one named most often."""
    counted = named.filter("a <> b").groupBy("b", "a").count()
    return counted.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")


def _open(postings: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Postings that may still lead to a link between different components.

    A unit is what one group has in one component. A posting is kept for every
    band of sizes in which, by length and position, a partner can be; postings
    of one token and pair of bands are dropped if all are of one component.
    """
    units = units.groupBy("gid", "label").agg(F.min("rep").alias("rep"))
    held = postings.join(units, "gid")
    bands = held.groupBy("token", F.col("band").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("one"), F.max("label").alias("two"))
    reach = int(-(-log(100 / percent) // log(BAND))) + 1
    wide = held.withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
    near = wide.join(bands, ["token", "other"]).filter("one <> two or one <> label")
    partner = F.greatest("least", F.expr(f"({percent} * n + 99) div 100"))
    fits = (partner <= F.col("most")) & (partner * percent <= F.col("n") * 100) & ((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + partner))
    near = near.filter(fits).withColumns({"low": F.least("band", "other"), "high": F.greatest("band", "other")})
    mixed = near.groupBy("token", "low", "high").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one < two").select("token", "low", "high")
    return near.drop("one", "two", "least", "most").join(mixed, ["token", "low", "high"])


def _rest(open_units: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Every pair of members in different components that the filters let through."""
    lengths = F.expr(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    bound = F.expr(f"(100 + {percent}) * least(na - pa, nb - pb) >= {percent} * (na + nb)")
    # Of two components under a token, b is the one with fewer units there: it is expanded first.
    labels = open_units.groupBy("token", "band", "other", "label").agg(F.count("*").alias("c"))
    swapped = labels.select("token", F.col("other").alias("band"), F.col("band").alias("other"), F.col("label").alias("lb"), F.col("c").alias("cb"))
    apart = (
        labels.withColumnsRenamed({"label": "la", "c": "ca"})
        .join(swapped, ["token", "band", "other"])
        .filter("ca > cb or (ca = cb and la < lb)")
        .filter("la <> lb")
        .drop("ca", "cb")
    )

    def side(s: str, band: str, other: str) -> DataFrame:
        return open_units.select("token", F.col("band").alias(band), F.col("other").alias(other), *(F.col(c).alias(f"{c[0]}{s}") for c in ("label", "gid", "n", "pos")))

    pairs = apart.join(side("b", "other", "band"), ["token", "band", "other", "lb"]).join(side("a", "band", "other"), ["token", "band", "other", "la"])
    groups = pairs.filter(lengths & bound).select("ga", "la", "gb", "lb").distinct()
    member = lambda s, r: units.select(F.col("gid").alias(f"g{s}"), F.col("label").alias(f"l{s}"), F.col("rep").alias(r))
    return groups.join(member("a", "a"), ["ga", "la"]).join(member("b", "b"), ["gb", "lb"]).select("a", "b").distinct()


ship_by_value(__name__)
