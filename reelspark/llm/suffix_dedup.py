"""Suffix-array dedup: repeats of at least ``least`` bytes, by common-prefix interval trees.

A suffix array of every byte of a corpus doesn't shuffle well; a sparse one does. Each window of
``least`` bytes chooses one of its seeds (``seed`` bytes, the least hash), so equal windows, wherever
they are, choose the same seed at the same offset, and only chosen positions become suffixes:
about 2 in ``least - seed + 2`` bytes. Suffixes with the same seed meet; each has its context, the
bytes that a window around it can reach. The different contexts of a seed form an enhanced suffix
array (suffixes sorted, neighbours' common prefixes); a stack scan lists its common-prefix intervals.
Within an interval the left contexts, sorted the same way, are scanned likewise: a part of the
interval whose members agree as far as they can to both sides, and differ beyond, is a maximal
repeat, and all its members are occurrences. A context that occurs twice is a group with itself.

A seed with more than ``most`` different contexts isn't sorted in one task: the contexts of all such seeds
are sorted by ranges, once to each side, and neighbours tell how far a context agrees with any other there,
across the ranges' borders too. No window that goes further can occur again. Copies of one text are held
against one of them, and only windows that may occur again beyond what both share are listed, each in the
one seed that it chooses; contexts that share one are a group, a repeat with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._anchors import FOUND, occurrences, packed, repeated, unpack
from reelspark.llm._store import id_value, materialize, texts
from reelspark.llm._text import Bytes, blocks, chosen, minimizers, mix, own_windows, runs, signed

#: Bytes of the shortest repeat.
LEAST = 200
#: Bytes of a seed.
SEED = 32
#: Different contexts of a seed that are sorted in one task; larger groups are split by windows.
MOST = 2000


def _context(hashes: Bytes, start: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(hashes.slices(start, at) + mix(hashes.slices(at, end)))


def _anchors(least: int, seed: int):
    width = least - seed + 1
    back, ahead = width - 1, least

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column("key").to_numpy(), batch.column("body").to_numpy()
            for first, last, data, offsets in blocks(batch):
                lengths = np.diff(offsets)
                row = np.repeat(np.arange(last - first), lengths)
                begin, end = offsets[:-1][row], offsets[1:][row]
                hashes = Bytes(data)
                seeds = hashes.windows(seed)
                place = np.arange(len(data))
                valid = (place + seed <= end)[: len(seeds)]
                at = minimizers(seeds, valid, width, place + least <= end)
                a, b = np.maximum(begin[at], at - back), np.minimum(end[at], at + ahead)
                own = row[at]
                yield occurrences(seeds[at], _context(hashes, a, at, b), keys[first:last][own], bodies[first:last][own], own, at - begin[at])

    return find


def _contexts(least: int, seed: int):
    """The bytes around the occurrences that are asked for: behind (backwards) and ahead of each suffix."""
    back, ahead = least - seed, least
    numbers = ["seed", "context", "n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = unpack(batch.column("packed")[i].as_py())
                found = batch.column("wanted")[i].values
                at = found.field("pos").to_numpy().tolist()
                ends = [pa.array([data[max(k - back, 0) : k][::-1] for k in at], pa.binary()), pa.array([data[k : k + ahead] for k in at], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(found.field(c) for c in numbers), *ends], [*numbers, "behind", "ahead"])

    return cut


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval, children before parents, by a stack scan."""
    stack = [(0, 0)]
    for i, depth in enumerate([*common, 0], 1):
        first = i - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


class _Ranges:
    """Least value of ranges of an array, from tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k) + 1])
        return out


def maximal_repeats(behind: list[bytes], ahead: list[bytes], least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members) of each maximal repeat of ``least`` bytes: how far it reaches from the seed, and all contexts that have it.

    behind: bytes before the suffix, backwards; ahead: bytes of the suffix. All differ as pairs.
    """
    n = len(ahead)
    if n == 2:  # one interval
        depth, extent = common_prefix(*ahead), common_prefix(*behind)
        if extent + depth >= least:
            yield extent, depth, np.arange(2)
        return
    order = np.array(sorted(range(n), key=ahead.__getitem__), np.int64)
    by_left = np.array(sorted(range(n), key=behind.__getitem__), np.int64)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    left_common = _Ranges(np.array([common_prefix(behind[a], behind[b]) for a, b in zip(by_left[:-1], by_left[1:], strict=True)], np.int64))
    right_common = np.array([common_prefix(ahead[a], ahead[b]) for a, b in zip(order[:-1], order[1:], strict=True)], np.int64)
    for depth, first, last in intervals(right_common.tolist()):
        members = order[first : last + 1]
        child = np.concatenate([[0], np.cumsum(right_common[first:last] == depth)])
        by_rank = np.argsort(rank[members])
        members, child = members[by_rank], child[by_rank]  # now sorted by left context
        near = left_common.least(rank[members[:-1]], rank[members[1:]] - 1)
        need = least - depth
        if need <= 0 and not near.all():
            yield 0, depth, members
        if near.max() < need:
            continue
        for extent, a, b in intervals(near.tolist()):
            # Of one child only: then the members agree further to the right, and are found there.
            if extent >= need and (child[a : b + 1] != child[a]).any():
                yield extent, depth, members[a : b + 1]


def repeats(behind: list[bytes], ahead: list[bytes], least: int) -> list[tuple[int, int]]:
    """How far each context is covered to its left and right by the maximal repeats that it is in; 0, 0 if in none."""
    reach = np.zeros((2, len(ahead)), np.int64)
    for left, right, members in maximal_repeats(behind, ahead, least):
        reach[0, members] = np.maximum(reach[0, members], left)
        reach[1, members] = np.maximum(reach[1, members], right)
    return list(zip(*reach.tolist(), strict=True))


def _by_seed(settle, names: list[str]):
    """Runs ``settle`` on the contexts of each seed of a partition that is sorted by seed; a seed may go on in the next batch."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("seed", "context", "n", "behind", "ahead")), strict=True):
                if group and group[0][0] != row[0]:
                    out += settle(group)
                    group = []
                if not group or group[-1][1] != row[1]:  # repeated rows lend a context twice
                    group.append(row)
            yield batch_of(out)
        if group:
            yield batch_of(settle(group))

    return run


def _reaches(least: int):
    def settle(rows: list[tuple]) -> list[tuple]:
        found = repeats([r[3] for r in rows], [r[4] for r in rows], least) if len(rows) > 1 else [(0, 0)]
        return [(*r[:2], *x) for r, x in zip(rows, found, strict=True) if sum(x) >= least]

    return _by_seed(settle, ["seed", "context", "left", "right"])


class _Repeat:
    """Names repeats by their bytes. A seed tells all occurrences of a repeat only if a window inside the repeat chooses it."""

    def __init__(self, least: int, seed: int):
        self.least, self.seed = least, seed

    def name(self, behind: bytes, ahead: bytes, left: int, right: int) -> int | None:
        data = np.frombuffer(behind[:left][::-1] + ahead[:right], np.uint8)
        hashes = Bytes(data)
        if not len(own_windows(hashes.windows(self.seed), left, self.least - self.seed + 1)):
            return None
        return int(signed(hashes.slices(np.array([0]), np.array([len(data)])))[0])


def _groups(least: int, seed: int):
    repeat = _Repeat(least, seed)

    def settle(rows: list[tuple]) -> list[tuple]:
        out = []
        for left, right, members in maximal_repeats([r[3] for r in rows], [r[4] for r in rows], least) if len(rows) > 1 else ():
            name = repeat.name(*rows[members[0]][3:], left, right)
            if name is not None:
                out += [(name, *rows[m][:2], left, right) for m in members.tolist()]
        return out + [(repeat.name(*r[3:], len(r[3]), len(r[4])), *r[:2], len(r[3]), len(r[4])) for r in rows if r[2] > 1]  # with itself

    return _by_seed(settle, ["repeat", "seed", "context", "left", "right"])


def _windows(least: int, seed: int, which: str = "all"):
    """The windows of ``least`` bytes that choose each context's seed and lie in ``far_left`` and ``far_right``: (repeat, seed, context, back, n).

    which: all; edges, only the outermost two; or beyond, those outside ``left`` and ``right`` of the row.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [*zip(batch.column("behind").to_pylist(), batch.column("ahead").to_pylist(), strict=True)]
            for i, j in runs([len(x) + len(y) for x, y in both]):
                part = batch.slice(i, j - i)
                data = np.frombuffer(b"".join([x[::-1] + y for x, y in both[i:j]]), np.uint8)
                sizes, before = (np.array(n, np.int64) for n in zip(*((len(x) + len(y), len(x)) for x, y in both[i:j]), strict=True))
                ends = np.cumsum(sizes)
                at = ends - sizes + before
                hashes = Bytes(data)
                seeds = hashes.windows(seed)
                place = chosen(seeds, np.ones(len(seeds), bool), least - seed + 1).astype(np.int64)
                row = np.repeat(np.arange(j - i), sizes)[: len(place)]
                start = np.flatnonzero((np.arange(len(place)) + least <= ends[row]) & (place == at[row]))
                row = row[start]
                back = at[row] - start
                may = (back <= part.column("far_left").to_numpy()[row]) & (least - back <= part.column("far_right").to_numpy()[row])
                row, start, back = row[may], start[may], back[may]
                keep = np.ones(len(row), bool)
                if which == "edges":
                    keep[1:-1] = (row[1:-1] != row[:-2]) | (row[1:-1] != row[2:])
                if which == "beyond":
                    keep = (back > part.column("left").to_numpy()[row]) | (least - back > part.column("right").to_numpy()[row])
                row, start, back = row[keep], start[keep], back[keep]
                columns = [signed(hashes.slices(start, start + least)), *(part.column(c).to_numpy()[row] for c in ("seed", "context")), back.astype(np.int32), part.column("n").to_numpy()[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["repeat", "seed", "context", "back", "n"])

    return hashed


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of ``side`` each context of a partition sorted by seed and side shares with a neighbour of its seed; the first and the last keep their side."""
    schema = pa.schema([("seed", pa.int64()), ("context", pa.int64()), ("shared", pa.int64()), ("side", pa.binary())])
    above, first = None, True
    for batch in batches:
        out = []
        for seed, context, side in zip(*(batch.column(c).to_pylist() for c in ("seed", "context", "side")), strict=True):
            shared = common_prefix(above[3], side) if above and above[0] == seed else 0
            if above:
                out.append((*above[:2], max(above[2], shared), above[3] if first else None))
                first = False
            above = (seed, context, shared, side)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, schema.types, strict=True)], schema=schema)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(above, schema.types, strict=True)], schema=schema)


def _most_shared(many: DataFrame, side: str) -> DataFrame:
    """(seed, context, shared): the longest start of ``side`` that a context has in common with another of its seed.

    All are sorted by ranges, so a seed's contexts may lie in many tasks; then the ends of ranges, two a task, are held against each other.
    """
    order, schema = ["seed", "side", "context"], "seed long, context long, shared long, side binary"
    rows = many.select("seed", "context", F.col(side).alias("side")).repartitionByRange(*order).sortWithinPartitions(*order)
    inner = materialize(rows.mapInArrow(_beside, schema), "suffix-beside")
    ends = inner.where("side IS NOT NULL").repartition("seed").sortWithinPartitions(*order).mapInArrow(_beside, schema)
    return inner.unionByName(ends).select("seed", "context", "shared")


def _bounded(many: DataFrame) -> DataFrame:
    """``many`` with ``far_left`` and ``far_right``: how far each context agrees with any other of its seed to either side."""
    many = materialize(many, "suffix-many")
    left, right = _most_shared(many, "behind"), _most_shared(many, "ahead")
    far = left.select("seed", "context", F.col("shared").alias("far_left"), F.lit(0).cast("long").alias("far_right"))
    far = far.unionByName(right.select("seed", "context", F.lit(0).cast("long").alias("far_left"), F.col("shared").alias("far_right")))
    far = far.groupBy("seed", "context").agg(F.max("far_left").alias("far_left"), F.max("far_right").alias("far_right"))
    return materialize(many.join(far, ["seed", "context"]), "suffix-bounded")


def _against(least: int):
    """How far each context is covered by what it shares with its seed's pivot; 0, 0 if that is no repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("behind", "ahead", "pivot_behind", "pivot_ahead")), strict=True):
                left, right = common_prefix(a, x), common_prefix(b, y)
                out.append((left, right) if left + right >= least else (0, 0))
            reach = list(zip(*out, strict=True)) or [(), ()]
            names = ["seed", "context", "n", "behind", "ahead", "far_left", "far_right"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(r, pa.int64()) for r in reach)], [*names, "left", "right"])

    return run


def _found(rows: DataFrame, least: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The occurrences of repeated seeds, and the bytes of their different contexts."""
    again = repeated(rows.mapInArrow(_anchors(least, seed), FOUND), "suffix")
    # One occurrence of each different context lends its bytes.
    lent = again.where("multi AND key = first").groupBy("seed", "context").agg(F.max("twice").alias("twice"), F.min(F.struct("key", "body", "pos")).alias("at"))
    asked = F.struct("seed", "context", F.when(F.col("twice"), 2).otherwise(1).cast("long").alias("n"), "at.pos")
    wanted = lent.groupBy("at.key", "at.body").agg(F.collect_list(asked).alias("wanted"))
    contexts = packed(rows).join(wanted, ["key", "body"]).mapInArrow(_contexts(least, seed), "seed long, context long, n long, behind binary, ahead binary")
    return again, materialize(contexts, "suffix-contexts")


def few_and_many(rows: DataFrame, most: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """The rows of seeds with ``most`` different contexts at most, and those of the others."""
    sizes = materialize(rows.groupBy("seed").agg(F.count_distinct("context").alias("different")).where(F.col("different") > most), f"{tag}-large")
    return rows.join(sizes, "seed", "left_anti"), rows.join(sizes, "seed", "left_semi").dropDuplicates(["seed", "context"])


_WINDOW = "repeat long, seed long, context long, back int, n long"
_ONE_WINDOW = ["repeat", "seed", "back"]


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """(repeat, seed, back, total) of the windows that occur more than once; written down, so that joins with it are plain ones."""
    return materialize(windows.groupBy(_ONE_WINDOW).agg(F.sum("n").alias("total")).where("total > 1"), "suffix-windows")


def _large_reaches(many: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, context, left, right) for seeds with many contexts: by the pivot, and by windows beyond what is shared with it."""
    many = _bounded(many)
    edges = materialize(many.mapInArrow(_windows(least, seed, "edges"), _WINDOW), "suffix-edges")
    # The pivot of a seed: the context whose outermost windows are the most common; any choice is right.
    common = edges.join(_repeated_windows(edges), _ONE_WINDOW).groupBy("seed", "context").agg(F.count(F.lit(1)).alias("edges"), F.min("total").alias("total"))
    pivots = common.groupBy("seed").agg(F.max(F.struct("edges", "total", "context")).alias("p")).select("seed", F.col("p.context").alias("context"))
    pivots = many.join(pivots, ["seed", "context"]).select("seed", F.col("context").alias("pivot"), F.col("behind").alias("pivot_behind"), F.col("ahead").alias("pivot_ahead"))
    pivots = materialize(pivots, "suffix-pivots")
    none = F.lit(b"")
    held = many.join(pivots, "seed", "left").where("pivot IS NULL OR context <> pivot").withColumns({"pivot_behind": F.coalesce("pivot_behind", none), "pivot_ahead": F.coalesce("pivot_ahead", none)})
    held = materialize(held.mapInArrow(_against(least), "seed long, context long, n long, behind binary, ahead binary, far_left long, far_right long, left long, right long"), "suffix-reaches")
    shared = held.where("left + right > 0").select("seed", "context", "left", "right")
    # Whoever has a window that isn't the pivot's in common with another has it beyond what it shares with the pivot, and so has the other.
    beyond = materialize(held.mapInArrow(_windows(least, seed, "beyond"), _WINDOW), "suffix-beyond")
    beyond = beyond.join(_repeated_windows(beyond).select(_ONE_WINDOW), _ONE_WINDOW)
    beyond = beyond.groupBy("seed", "context").agg(F.max("back").cast("long").alias("left"), (F.lit(least) - F.min("back")).cast("long").alias("right"))
    own = shared.groupBy("seed").agg(F.max("left").alias("left"), F.max("right").alias("right")).join(pivots, "seed").select("seed", F.col("pivot").alias("context"), "left", "right")
    return shared.unionByName(beyond).unionByName(own)


def _span(left: Column | str, right: Column | str) -> list[Column]:
    """From ``left`` bytes before an occurrence to ``right`` after it."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    return [F.greatest(F.col("pos") - at(left), F.lit(0)).cast("int").alias("start"), (F.col("last") + at(right)).cast("int").alias("end")]


def _repeated_spans(rows: DataFrame, least: int, seed: int, most: int) -> DataFrame:
    """(key, body, spans)"""
    again, contexts = _found(rows, least, seed)
    few, many = few_and_many(contexts, most, "suffix")
    reach = "seed long, context long, left long, right long"
    settled = few.repartition("seed").sortWithinPartitions("seed", "context").mapInArrow(_reaches(least), reach)
    settled = settled.unionByName(_large_reaches(many, least, seed))
    same = again.where("twice").select("key", "body", *_span(F.lit(least - seed), F.lit(least)))
    mixed = again.where("multi AND NOT twice").join(settled, ["seed", "context"]).select("key", "body", *_span("left", "right"))
    spans = same.unionByName(mixed).groupBy("key", "body").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return materialize(spans, "suffix-spans")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(repeat, length, id, body, start, end): every maximal repeat with all its occurrences, a row each.

    repeat: a hash of the repeated bytes; body: the hash of the row's text. A repeat is seen through
    ``least - seed`` bytes before and ``least`` after each seed in it, so a longer one is a chain of
    groups that overlap. Repeats are listed from the shortest to the longest that hold: one inside
    another has more occurrences. Null texts are empty, null ids stay null, repeated rows are one
    occurrence each. Around seeds with more than ``most`` contexts each repeated window is a group.
    """
    rows = texts(docs, id_col, text_col)
    again, contexts = _found(rows, least, seed)
    few, many = few_and_many(contexts, most, "suffix")
    schema = "repeat long, seed long, context long, left long, right long"
    found = few.repartition("seed").sortWithinPartitions("seed", "context").mapInArrow(_groups(least, seed), schema)
    alone = F.col("n") > 1  # a context that occurs twice has all its windows in common with itself
    many = _bounded(many).withColumns({"far_left": F.when(alone, least).otherwise(F.col("far_left")), "far_right": F.when(alone, least).otherwise(F.col("far_right"))})
    windows = materialize(many.mapInArrow(_windows(least, seed), _WINDOW), "suffix-listed")
    shared = windows.join(_repeated_windows(windows), _ONE_WINDOW)
    found = found.unionByName(shared.select("repeat", "seed", "context", F.col("back").cast("long").alias("left"), (F.lit(least) - F.col("back")).cast("long").alias("right")))
    # A repeated context without others has no array to be in: it is a group as it stands.
    lone = again.where("NOT multi").select(F.xxhash64("seed", "context").alias("repeat"), "seed", "context", F.lit(least - seed).cast("long").alias("left"), F.lit(least).cast("long").alias("right")).distinct()
    hits = again.join(found.unionByName(lone).distinct(), ["seed", "context"])
    ends = rows.select("key", "body", F.octet_length("text").alias("n_bytes")).distinct()
    hits = hits.select("repeat", "key", "body", *_span("left", "right")).join(ends, ["key", "body"])
    return hits.select("repeat", (F.least("end", "n_bytes") - F.col("start")).alias("length"), id_value("key").alias(id_col), "body", "start", F.least("end", "n_bytes").alias("end")).distinct()


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["start"], min(s["end"], length)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts_, spans = batch.column("packed"), batch.column("spans")
        out = []
        for i in range(batch.num_rows):
            data = unpack(texts_[i].as_py())
            gone = merged(spans[i].as_py(), len(data))
            kept, at = [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())], ["__key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seed: int = SEED, most: int = MOST) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes left after the removals).

    Matches don't cross rows. A null text is empty. Rows are known by id and text, so those that share
    an id (null or not) are judged each for itself. Repeated rows are copies, so each loses all of a
    text of ``least`` bytes or more; all occurrences are removed, so ties don't arise. An empty table
    gives an empty table.
    """
    rows = texts(docs, id_col, text_col)
    joined = packed(rows).join(_repeated_spans(rows, least, seed, most), ["key", "body"], "left")
    out = joined.mapInArrow(_removed, "__key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(id_value("__key").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
