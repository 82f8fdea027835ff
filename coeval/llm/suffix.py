"""Removal of long repeated byte strings by distributed prefix doubling.

A position's rank at offset h names the h bytes from it; the rank at 2h is the
pair of the ranks at the position and h further on. Spark deals the ranked
positions out by rank, sorts them within each part and sends word back to those
whose rank is not unique. Ranks are fingerprints of such pairs, so a rank means
the same everywhere and no numbering has to be agreed on.

Doubling starts at a power of two near a third of the threshold and on anchors
only: positions picked by a hash of the few bytes after them, so equal strings
have equal anchors. An anchor whose rank is unique rules out every start of a
long string that would contain it. The rest is ranked again at twice the offset,
and what is left is past the threshold: runs of starts between anchors are
ranked whole, with all bytes their strings cover. A run that recurs settles all
its starts. The starts of runs that do not recur are ranked one by one, at the
threshold itself, and with them those of one copy of every run that recurs and
is followed by the same anchor as one that does not: a start's string holds that
anchor, so no other run can have the same string.

A batch sends each rank once, so a string found everywhere costs one row a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coeval.llm.common import M1, M2, bites, drop_table, part_count, scramble, ship_by_value, short_batches, small_side
from coeval.session import RunFolder

#: Bytes ranked at a time, and most starts in one run.
SEGMENT, RUN = 1 << 18, 256
LEAST_LENGTH = 16
#: Text that a part of the ranks stands for, in MB; a part is sorted in one task's memory.
PART_MB = 6

DEALT = "part int, first binary, second binary, docs binary, places binary, known binary, doc bigint, found binary, lead binary"
REPLY = "doc bigint, found binary, lead binary"


class Steps:
    """Offsets that belong to a threshold, in bytes."""

    def __init__(self, length: int) -> None:
        if length < LEAST_LENGTH:
            raise ValueError(f"length must be at least {LEAST_LENGTH}")
        self.length = length
        self.long = 1 << (length.bit_length() - 1)
        self.short = self.long // 2
        self.anchor = max(1, self.short // 8)
        self.spread = 1 << (max(1, length // 12).bit_length() - 1)


def _pieces(texts: list[bytes], look: int):
    """Texts cut and joined to arrays of about SEGMENT bytes.

    Yields (array, piece table); a piece row is text number, place in the array,
    place in the text, positions it owns. Up to ``look`` bytes follow these.
    """
    data, rows, filled = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), SEGMENT):
            part = text[at : at + SEGMENT + look]
            rows.append((i, filled, at, min(SEGMENT, len(text) - at)))
            data.append(part)
            filled += len(part)
            if filled >= SEGMENT:
                yield np.frombuffer(b"".join(data) + bytes(look + 16), np.uint8), np.array(rows, np.int64)
                data, rows, filled = [], [], 0
    if rows:
        yield np.frombuffer(b"".join(data) + bytes(look + 16), np.uint8), np.array(rows, np.int64)


def _ranks(array: np.ndarray, offset: int, also: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Rank of every position at ``offset``, and at the smaller ``also``."""
    size = min(8, offset, also or 8)
    n = len(array) - 8
    ranks = np.ndarray((n,), np.uint64, array.tobytes(), 0, (1,)).copy()
    if size < 8:
        ranks &= np.uint64((1 << (8 * size)) - 1)
    ranks = scramble(ranks)
    kept = ranks.copy() if also == size else None
    while size < offset:
        ranks = scramble(ranks[:-size] * M1 + ranks[size:] * M2)
        size *= 2
        if size == also:
            kept = ranks.copy()
    return ranks, kept


def _anchors(texts: list[bytes], steps: Steps, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and rank at ``offset`` of all anchors that have so many bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owners, places, names = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for array, rows in _pieces(texts, max(offset, steps.anchor)):
        ranks, picked = _ranks(array, offset, steps.anchor)
        picked = ranks if picked is None else picked
        at = np.nonzero((picked[: len(ranks)] >> np.uint64(40)) & np.uint64(steps.spread - 1) == 0)[0]
        piece = np.searchsorted(rows[:, 1], at, side="right") - 1
        shift = at - rows[piece, 1]
        owner, place = rows[piece, 0], shift + rows[piece, 2]
        good = (shift < rows[piece, 3]) & (place + offset <= sizes[owner]) & (sizes[owner] >= steps.length)
        owners.append(owner[good])
        places.append(place[good])
        names.append(ranks[at[good]])
    return np.concatenate(owners), np.concatenate(places), np.concatenate(names)


def _at(texts: list[bytes], places: list[np.ndarray], offset: int, reach: int, read) -> list[np.ndarray]:
    """``read(ranks, index, text number, selection)`` for given sorted places of every text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for array, rows in _pieces(texts, reach + offset):
        ranks, _ = _ranks(array, offset)
        for i, base, start, owned in rows:
            a, b = np.searchsorted(places[i], [start, start + owned])
            if a < b:
                out[i].append(read(ranks, places[i][a:b] - start + base, i, slice(a, b)))
    return [np.concatenate(x) if x else np.empty((0, 2), np.uint64) for x in out]


def _clear(alive: np.ndarray, places: np.ndarray, back: int) -> None:
    """Rule out the starts from ``back`` before each place up to it."""
    marks = np.zeros(len(alive) + 1, np.int64)
    inside = places - back < len(alive)
    places = places[inside]
    np.add.at(marks, np.maximum(places - back, 0), 1)
    np.add.at(marks, np.minimum(places + 1, len(alive)), -1)
    alive[np.cumsum(marks[:-1]) > 0] = False


def _edges(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, in turn."""
    return np.nonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))[0]


def _flags(edges: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size + 1, np.int8)
    marks[edges[::2]] += 1
    marks[edges[1::2]] -= 1
    return np.cumsum(marks[:-1]).astype(bool)


def _words(cell, kind=np.uint32) -> np.ndarray:
    """Integers of one binary value, or of a list of them."""
    value = cell.as_py()
    if value is None:
        return np.empty(0, kind)
    return np.frombuffer(value if isinstance(value, bytes) else b"".join(value), kind)


def _deal(first, second, docs, places, wants, parts):
    """Rows that send each rank of the batch to its part once.

    ``wants`` says which positions ask for word. Ranks the batch itself holds
    twice are answered in rows of their own.
    """
    order = np.lexsort((first,) if second is None else (second, first))
    new = np.ones(len(order), bool)
    if len(order):
        same = first[order][1:] == first[order][:-1]
        if second is not None:
            same &= second[order][1:] == second[order][:-1]
        new[1:] = ~same
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=1)
    # The one to send is one that asks, if any does.
    asks = wants[order]
    best = np.lexsort((~asks, group)) if len(order) else order
    heads = best[np.searchsorted(group[best], np.arange(group[-1] + 1 if len(group) else 0))]
    sent = order[heads]
    known = size[group[heads]] > 1 if len(order) else np.empty(0, bool)
    twice = np.ones(len(order), bool)
    twice[heads] = False
    answered = order[twice & asks]
    rows = {k: [] for k in ("part", "first", "second", "docs", "places", "known", "doc", "found", "lead")}

    def add(**row):
        for k in rows:
            rows[k].append(row.get(k))

    part = (first[sent] >> np.uint64(32)).astype(np.int64) * parts >> 32
    by = np.argsort(part, kind="stable")
    # Order of position inside a part compresses well.
    by = by[np.lexsort((sent[by], part[by]))]
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    owner = np.where(wants, docs, 0)
    for k in range(parts):
        mine = by[cuts[k] : cuts[k + 1]]
        if len(mine):
            at = sent[mine]
            flag = known[mine].astype(np.uint8) + 2 * wants[at].astype(np.uint8)
            add(
                part=k,
                first=first[at].tobytes(),
                second=None if second is None else second[at].tobytes(),
                docs=owner[at].astype(np.int64).tobytes(),
                places=places[at].astype(np.uint32).tobytes(),
                known=flag.tobytes(),
            )
    keys = np.unique(docs[answered])
    mine = answered[np.argsort(docs[answered], kind="stable")]
    cuts = np.searchsorted(docs[mine], keys)
    for key, a, b in zip(keys, cuts, [*cuts[1:], len(mine)]):
        add(part=int(key) % parts, doc=int(key), found=places[mine[a:b]].astype(np.uint32).tobytes(), lead=b"")
    kinds = {"part": pa.int32(), "doc": pa.int64()}
    return pa.record_batch({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


def _settler():
    """Answer the positions of a part whose rank is not unique; one of each rank leads."""

    def run(table: pa.Table) -> pa.Table:
        plain = table.filter(table.column("first").is_valid())
        get = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_py(), kind) for x in plain.column(name) if x.is_valid)])
        first, docs, places, known = get("first", np.uint64), get("docs", np.int64), get("places", np.uint32), get("known", np.uint8)
        second = get("second", np.uint64)
        order = np.lexsort((docs, first) if not len(second) else (docs, second, first))
        first, docs, places, known = first[order], docs[order], places[order], known[order]
        same = first[1:] == first[:-1]
        if len(second):
            second = second[order]
            same &= second[1:] == second[:-1]
        new = np.concatenate([np.ones(min(1, len(first)), bool), ~same])
        group = np.cumsum(new) - 1
        shared = np.bincount(group, minlength=1) > 1
        np.logical_or.at(shared, group[(known & 1) > 0], True)
        told = shared[group] & ((known & 2) > 0) if len(group) else np.empty(0, bool)
        leads = told.copy()
        at = np.nonzero(told)[0]
        if len(at):
            leads[at] = np.concatenate([[True], group[at][1:] != group[at][:-1]])
        docs, places, leads = docs[told], places[told], leads[told]
        by = np.argsort(docs, kind="stable")
        docs, places, leads = docs[by], places[by], leads[by]
        keys, cuts = np.unique(docs, return_index=True)
        ends = [*cuts[1:], len(docs)]
        answer = pa.table(
            {
                "doc": pa.array(keys, pa.int64()),
                "found": pa.array([places[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                "lead": pa.array([places[a:b][leads[a:b]].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            }
        )
        passed = table.filter(table.column("doc").is_valid()).select(["doc", "found", "lead"])
        return pa.concat_tables([passed.cast(answer.schema), answer])

    return run


def _settled(dealt: DataFrame) -> DataFrame:
    replies = dealt.groupBy("part").applyInArrow(_settler(), REPLY)
    return replies.groupBy("doc").agg(F.collect_list("found").alias("found"), F.collect_list("lead").alias("lead"))


def _short_ranks(length: int, parts: int):
    """(doc, bytes) to dealt anchors at the first offset; a text with a long way between anchors is answered at once."""

    def run(batches):
        steps = Steps(length)
        back = steps.length - steps.short
        for batch in bites(batches, 1):
            keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts = [x.as_py() or b"" for x in batch.column(1)]
            owner, place, name = _anchors(texts, steps, steps.short)
            yield _deal(name, None, keys[owner], place, np.ones(len(name), bool), parts)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            bare = []
            for i, text in enumerate(texts):
                last = len(text) - steps.length
                mine = place[cuts[i] : cuts[i + 1]]
                if last >= 0 and np.diff(np.concatenate([[-1], mine[mine < last], [mine[mine >= last][0] if (mine >= last).any() else last + back + 2]])).max() > back + 1:
                    bare.append(int(keys[i]))
            rows = {k: pa.nulls(len(bare), pa.binary()) for k in ("first", "second", "docs", "places", "known")}
            rows |= {"part": pa.array([k % parts for k in bare], pa.int32()), "doc": pa.array(bare, pa.int64())}
            rows |= {k: pa.array([b""] * len(bare), pa.binary()) for k in ("found", "lead")}
            yield pa.record_batch({k: rows[k] for k in ("part", "first", "second", "docs", "places", "known", "doc", "found", "lead")})

    return run


def _narrow(length: int, level: str):
    """(doc, bytes, alive or null, found) to the texts with starts that are still possible."""

    def run(batches):
        steps = Steps(length)
        offset = getattr(steps, level)
        for batch in bites(batches, 1):
            keys, texts = batch.column(0), [x.as_py() or b"" for x in batch.column(1)]
            owner, place, _ = _anchors(texts, steps, offset)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            keep, edges = [], []
            for i, text in enumerate(texts):
                size = max(0, len(text) - steps.length + 1)
                old = batch.column(2)[i]
                alive = _flags(_words(old), size) if old.is_valid else np.ones(size, bool)
                mine = place[cuts[i] : cuts[i + 1]]
                lone = ~np.isin(mine, _words(batch.column(3)[i]))
                if level == "long":
                    lone &= _touching(alive, mine, steps.length - offset)
                _clear(alive, mine[lone], steps.length - offset)
                if alive.any():
                    keep.append(i)
                    edges.append(_edges(alive).astype(np.uint32).tobytes())
            keep = pa.array(keep, pa.int64())
            yield pa.record_batch({"doc": keys.take(keep), "bytes": batch.column(1).take(keep), "alive": pa.array(edges, pa.binary())})

    return run


def _touching(alive: np.ndarray, places: np.ndarray, back: int) -> np.ndarray:
    """Which places lie in a string from a possible start, ``back`` bytes or fewer on."""
    sums = np.concatenate([[0], np.cumsum(alive)])
    low = np.clip(places - back, 0, len(alive))
    return sums[np.clip(places + 1, 0, len(alive))] > sums[low]


def _long_ranks(length: int, parts: int):
    """(doc, bytes, alive) to dealt anchors at the second offset."""

    def run(batches):
        steps = Steps(length)
        for batch in bites(batches, 1):
            keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts = [x.as_py() for x in batch.column(1)]
            owner, place, name = _anchors(texts, steps, steps.long)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            near = np.zeros(len(owner), bool)
            for i, text in enumerate(texts):
                alive = _flags(_words(batch.column(2)[i]), len(text) - steps.length + 1)
                near[cuts[i] : cuts[i + 1]] = _touching(alive, place[cuts[i] : cuts[i + 1]], steps.length - steps.long)
            yield _deal(name[near], None, keys[owner[near]], place[near], np.ones(int(near.sum()), bool), parts)

    return run


def _runs(texts: list[bytes], alive: list[np.ndarray], steps: Steps) -> list[tuple[np.ndarray, np.ndarray]]:
    """Possible starts of every text cut to runs at anchors: first starts and sizes."""
    owner, place, _ = _anchors(texts, steps, steps.anchor)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        edges, mine = alive[i].astype(np.int64), place[cuts[i] : cuts[i + 1]]
        begins = np.unique(np.concatenate([edges, mine]))
        inside = np.searchsorted(edges, begins, side="right") % 2 == 1
        sizes = np.diff(np.concatenate([begins, begins[-1:]]))
        begins, sizes = begins[inside], sizes[inside]
        times = -(-sizes // RUN)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first = np.repeat(begins, times) + nth * RUN
        out.append((first, np.minimum(RUN, np.repeat(begins + sizes, times) - first)))
    return out


def _run_ranks(length: int, parts: int):
    """(doc, bytes, alive) to dealt runs of starts, ranked with all bytes of their strings."""

    def run(batches):
        steps = Steps(length)
        for batch in bites(batches, 1):
            keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts = [x.as_py() for x in batch.column(1)]
            runs = _runs(texts, [_words(x) for x in batch.column(2)], steps)

            def name(ranks, at, i, chosen, runs=runs):
                total = runs[i][1][chosen] - 1 + steps.length
                one, two = total.astype(np.uint64), total.astype(np.uint64) + M2
                for k in range(-(-(RUN + steps.length) // steps.long)):
                    value = ranks[at + np.minimum(k * steps.long, total - steps.long)]
                    one, two = scramble(one * M1 + value), scramble(two * M2 + value)
                return np.stack([one, two], 1)

            names = _at(texts, [r[0] for r in runs], steps.long, RUN + steps.length, name)
            both = np.concatenate([np.empty((0, 2), np.uint64), *names])
            counts = [len(r[0]) for r in runs]
            yield _deal(both[:, 0].copy(), both[:, 1].copy(), np.repeat(keys, counts), np.concatenate([np.empty(0, np.int64), *(r[0] for r in runs)]), np.ones(len(both), bool), parts)

    return run


def _next_anchors(begins: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run: index of the first anchor after it; whether strings of some starts hold that, and of all."""
    at = np.searchsorted(anchors, begins + sizes)
    place = np.append(anchors, np.iinfo(np.int64).max)[at]
    reach = steps.length - steps.long
    return at, place - (begins + sizes - 1) <= reach, place - begins <= reach


def _next_ranks(length: int, parts: int):
    """(doc, bytes, alive, found, lead) to dealt anchors after runs: those of leads ask whether a run that does not recur has the same."""

    def run(batches):
        steps = Steps(length)
        for batch in bites(batches, 1):
            keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts = [x.as_py() for x in batch.column(1)]
            runs = _runs(texts, [_words(x) for x in batch.column(2)], steps)
            owner, place, name = _anchors(texts, steps, steps.long)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
            for i, (first, sizes) in enumerate(runs):
                shared, leads = np.isin(first, _words(batch.column(3)[i])), np.isin(first, _words(batch.column(4)[i]))
                at, some, _ = _next_anchors(first, sizes, place[cuts[i] : cuts[i + 1]], steps)
                send = (~shared | leads) & some
                out.append((name[cuts[i] : cuts[i + 1]][at[send]], np.full(int(send.sum()), keys[i]), first[send], leads[send]))
            names, docs, places, asks = (np.concatenate([x[k] for x in out]) for k in range(4))
            yield _deal(names, None, docs, places, asks, parts)

    return run


def _start_ranks(length: int, parts: int):
    """(doc, bytes, alive, found, lead, wanted) to dealt single starts at the threshold.

    Leads send theirs where an anchor after them is wanted, or is too far off to tell.
    """

    def run(batches):
        steps = Steps(length)
        for batch in bites(batches, 1, 1 << 20):
            keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts = [x.as_py() for x in batch.column(1)]
            runs = _runs(texts, [_words(x) for x in batch.column(2)], steps)
            owner, anchors, _ = _anchors(texts, steps, steps.long)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            places, asks = [], []
            for i, (first, sizes) in enumerate(runs):
                shared, leads = np.isin(first, _words(batch.column(3)[i])), np.isin(first, _words(batch.column(4)[i]))
                _, _, every = _next_anchors(first, sizes, anchors[cuts[i] : cuts[i + 1]], steps)
                send = ~shared | (leads & (~every | np.isin(first, _words(batch.column(5)[i]))))
                begin, size = first[send], sizes[send]
                places.append(np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum()))
                asks.append(np.repeat(~shared[send], size))

            def name(ranks, at, i, chosen):
                return np.stack([ranks[at], ranks[at + steps.length - steps.long]], 1)

            names = np.concatenate([np.empty((0, 2), np.uint64), *_at(texts, places, steps.long, steps.length, name)])
            flat, ask = np.concatenate([np.empty(0, np.int64), *places]), np.concatenate([np.empty(0, bool), *asks])
            yield _deal(names[:, 0].copy(), names[:, 1].copy(), np.repeat(keys, [len(x) for x in places]), flat, ask, parts)

    return run


def _cutter(length: int):
    """(doc, bytes, alive, run and start answers) to spans and what is kept."""

    def run(batches):
        steps = Steps(length)
        for batch in bites(batches, 1):
            texts = [x.as_py() for x in batch.column(1)]
            runs = _runs(texts, [_words(x) for x in batch.column(2)], steps)
            keep, spans, kept = [], [], []
            for i, text in enumerate(texts):
                first, sizes = runs[i]
                shared = np.isin(first, _words(batch.column(3)[i]))
                lone = _words(batch.column(4)[i]).astype(np.int64)
                begin, end = np.concatenate([first[shared], lone]), np.concatenate([first[shared] + sizes[shared], lone + 1])
                if not len(begin):
                    continue
                marks = np.zeros(len(text) + 1, np.int64)
                np.add.at(marks, begin, 1)
                np.add.at(marks, end - 1 + steps.length, -1)
                edges = _edges(np.cumsum(marks[:-1]) > 0)
                keep.append(i)
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                outer = [0, *map(int, edges), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(outer[::2], outer[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch({"doc": batch.column(0).take(pa.array(keep, pa.int64())), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return run


def row_key(id_column: str, text: str) -> F.Column:
    """What names a row here: a hash of its id and text."""
    return F.xxhash64(id_column, text)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """Bytes covered by strings of ``length`` bytes that start in more than one place.

    Texts are UTF-8 bytes, strings do not cross texts, overlapping places count
    as two. Returns one row per distinct (id, text) with something to remove:
    key bigint (``row_key``), spans array<struct<start, stop>> in order, kept
    binary, the other bytes in order. Strings are compared by two 64-bit ranks.

    Null and empty texts, and texts below ``length``, have no such strings.
    Very long texts are ranked whole, a segment at a time. Rows that repeat an id
    and text are copies of each other; null ids are like any other. An empty
    table gives no rows; other columns are not read.
    """
    Steps(length)
    run = RunFolder(docs.sparkSession)
    short_batches(docs.sparkSession)
    plain = docs.select(row_key(id_column, text).alias("doc"), F.col(text).cast("binary").alias("bytes"))
    parts = part_count(plain, "bytes", PART_MB)
    body = "doc bigint, bytes binary, alive binary"

    found = run.table("short", _settled(plain.mapInArrow(_short_ranks(length, parts), DEALT)))
    texts = plain.join(small_side(found.select("doc")), "doc", "left_semi").join(found, "doc")
    work = run.table("work", texts.select("doc", "bytes", F.lit(None).cast("binary").alias("alive"), "found").mapInArrow(_narrow(length, "short"), body))
    found = run.table("long", _settled(work.mapInArrow(_long_ranks(length, parts), DEALT)))
    texts = work.join(found, "doc", "left").select("doc", "bytes", "alive", F.coalesce("found", F.array().cast("array<binary>")).alias("found"))
    work = run.table("rest", texts.mapInArrow(_narrow(length, "long"), body))
    for step in ("short", "work", "long"):
        drop_table(run, step)
    runs = run.table("runs", _settled(work.mapInArrow(_run_ranks(length, parts), DEALT)))
    texts = work.join(runs, "doc", "left").select("doc", "bytes", "alive", "found", "lead")
    wanted = run.table("wanted", _settled(texts.mapInArrow(_next_ranks(length, parts), DEALT)).select("doc", F.col("found").alias("wanted")))
    texts = work.join(runs.join(wanted, "doc", "left"), "doc", "left").select("doc", "bytes", "alive", "found", "lead", "wanted")
    starts = run.table("starts", _settled(texts.mapInArrow(_start_ranks(length, parts), DEALT)).select("doc", F.col("found").alias("lone")))
    answers = runs.select("doc", "found").join(starts, "doc", "full")
    cut = work.join(answers, "doc").select("doc", "bytes", "alive", "found", "lone").mapInArrow(_cutter(length), "doc bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    result = run.table("spans", cut.withColumnRenamed("doc", "key").dropDuplicates(["key"]))
    for step in ("rest", "runs", "wanted", "starts"):
        drop_table(run, step)
    return result


ship_by_value(__name__)
