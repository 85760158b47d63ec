"""Change points of long sequences by a kernel cost, exactly, over several tasks.

A sequence of up to ``WHOLE`` blocks of rows is searched by one task. Longer ones are searched block by block, many sequences at
once. The kernel is never held: it is worked out anew, tile by tile, wherever it is summed, and neither tiles nor
sums of pairs are written or exchanged. An earlier block stays in the task that read it, and the block at hand
comes to it by broadcast (a bounded number of sequences at a time): first to sum the kernel over each earlier block, then, with what lies
between the two, to say at what least cost a segment that starts in the earlier block ends at each row, and which
start that is. One task a sequence goes on from these through the block's own rows. Between blocks only a start's total
and the kernel's sum since it are kept; both steps' tables grow with the rows times the number of blocks, and blocks get longer
as sequences do. The kernel's width is the exact median of all pairs' squared distances: pairs are counted by ranges, tile by tile,
the middle range by finer ranges, until few are left to be sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.sources.shared import kept

#: Rows of a block: of a short one, of the longest, and how many blocks a sequence has before its blocks get longer.
BLOCK, LONGEST, STEPS = 1024, 8192, 32
#: Sequences of up to so many blocks are one task's. Columns of a tile at a time.
WHOLE, COLUMNS = 16, 32
#: Numbers in the vectors that are broadcast at once, and sequences that are searched at once.
PANEL, ABREAST = 1 << 21, 256
#: Ranges of distances that are counted, how many times the middle one is divided, and how many pairs in it are sorted without that.
RANGES, LEVELS, FEW = 1 << 12, 3, 1 << 16
#: The least and the most that a distance over the width counts as.
NEAREST, FARTHEST = 1e-2, 1e2
_DIAGONAL = float(np.exp(-NEAREST))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    d = _squared(a, b)
    d /= -width
    return np.exp(np.clip(d, -FARTHEST, -NEAREST, out=d), out=d)


def _each(rows: DataFrame, keys: list[str], of: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``of`` taken of each row alone, where it is read: nothing is exchanged, and Spark bounds the bytes of a batch. keys: what there is one row of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                yield from of(iter([batch.iloc[i : i + 1]]))

    return rows.select(*keys, *[c for c in rows.columns if c not in keys]).mapInPandas(run, schema)


def _columns(n: int) -> Iterator[slice]:
    return (slice(i, min(i + COLUMNS, n)) for i in range(0, n, COLUMNS))


def _matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(int(n), -1)


def _flat(blocks: DataFrame, name: str, *more: str) -> DataFrame:
    """The blocks' vectors as one array of numbers, and how many vectors these are."""
    return blocks.select("sid", "block", F.flatten("xs").alias(name), F.size("xs").alias(f"n{name}"), *more)


def _tiles(blocks: DataFrame) -> list[DataFrame]:
    """(sid, block, b, xs, nxs, top, ys, nys) of each pair of a sequence's blocks, by panels of the later one; a panel is broadcast."""
    sizes = blocks.groupBy("block").agg(F.sum(F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + F.size(x)))).sort("block").collect()
    panels: list[list[int]] = []
    held = 0
    for b, numbers in sizes:
        if not panels or held + numbers > PANEL:
            panels.append([b, b])
            held = 0
        panels[-1][1], held = b, held + numbers
    one, other = _flat(blocks, "xs", "top"), _flat(blocks, "ys").withColumnRenamed("block", "b")
    return [one.join(F.broadcast(other.where(F.col("b").between(*p))), "sid").where("block <= b") for p in panels]


def _cells(at: np.ndarray) -> np.ndarray:
    return np.minimum(at, RANGES - 1).astype(np.int64)


def _strips(a: np.ndarray, b: np.ndarray, same: bool, top: float, low: list[int], high: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distances, their places among the ranges) of the pairs of a tile that lie within all of the ranges so far, some columns at a time."""
    for c in _columns(len(b)):
        d = _squared(a[: c.stop] if same else a, b[c])
        d = d[np.arange(c.stop)[:, None] < np.arange(c.start, c.stop)] if same else d.ravel()
        at = d * (RANGES / (4 * top or RANGES))
        for lo, hi in zip(low, high, strict=True):
            cell = _cells(at)
            here = (cell >= lo) & (cell <= hi)
            d, at = d[here], (at[here] - lo) * (RANGES / (hi + 1 - lo))
        yield d, at


def _count(strips: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return sum((np.bincount(_cells(at), minlength=RANGES) for _, at in strips), np.zeros(RANGES, np.int64))


def _list(strips: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distances and how often they are met; equal ones of different strips are not brought together."""
    values, n = zip(*(np.unique(d, return_counts=True) for d, _ in strips), strict=True)
    return np.concatenate(values), np.concatenate(n)


def _width(x: np.ndarray) -> float:
    """``widths`` of one sequence in one task."""
    pairs = len(x) * (len(x) - 1) // 2
    if not pairs:
        return 1.0
    top, low, high, before, inside = float((x**2).sum(1).max()), [], [], 0, pairs
    ranks = [(pairs - 1) // 2, pairs // 2]
    while not low or inside > FEW and len(low) < LEVELS:
        held = _count(_strips(x, x, True, top, low, high))
        lo, hi = np.searchsorted(before + held.cumsum(), ranks, side="right")
        before, inside = before + int(held[:lo].sum()), int(held[lo : hi + 1].sum())
        low, high = [*low, int(lo)], [*high, int(hi)]
    values, n = _list(_strips(x, x, True, top, low, high))
    order = values.argsort()
    return float(values[order][np.searchsorted(before + n[order].cumsum(), ranks, side="right")].mean()) or 1.0


def _tile_strips(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    for batch in batches:
        for sid, block, b, xs, nxs, ys, nys, top, low, high in zip(*(batch[c] for c in ("sid", "block", "b", "xs", "nxs", "ys", "nys", "top", "low", "high")), strict=True):
            yield sid, _strips(_matrix(xs, nxs), _matrix(ys, nys), block == b, top, low, high)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for sid, strips in _tile_strips(batches):
        held = _count(strips)
        cells = np.flatnonzero(held)
        yield pd.DataFrame({"sid": sid, "cell": cells.astype(float), "n": held[cells]})


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for sid, strips in _tile_strips(batches):
        values, n = _list(strips)
        yield pd.DataFrame({"sid": sid, "cell": values, "n": n})


def widths(blocks: DataFrame) -> DataFrame:
    """(sid, width): the median of the squared distances of all pairs of a sequence's rows; 1 where it is 0 or there is no pair."""
    by, none = Window.partitionBy("sid"), F.array().cast("array<bigint>")
    tiles = _tiles(blocks)
    ranges = blocks.select("sid").distinct().select("sid", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("pairs"))

    def middle(of: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
        """(sid, low, high, pairs, first, last, inside, under): the cells, or values, of the two middle pairs; how many pairs are in these and before."""
        held = [_each(t.join(F.broadcast(ranges.select("sid", "low", "high")), "sid"), ["sid", "block", "b"], of, "sid long, cell double, n long").groupBy("sid", "cell").agg(F.sum("n").alias("n")) for t in tiles]
        if len(held) > 1:  # one after the other: in one job all panels would be broadcast at once
            held = [kept(h, "kernel-counts") for h in held]
        n = reduce(DataFrame.unionByName, held).groupBy("sid", "cell").agg(F.sum("n").alias("n"))
        n = n.join(F.broadcast(ranges), "sid").withColumn("pairs", F.coalesce("pairs", F.sum("n").over(by))).withColumn("upto", F.col("before") + F.sum("n").over(by.orderBy("cell")))
        met = (F.col("upto") > F.floor((F.col("pairs") - 1) / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("pairs") / 2))
        return n.where(met).groupBy("sid", "low", "high", "pairs").agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.sum("n").alias("inside"), F.min(F.col("upto") - F.col("n")).alias("under"))

    for _ in range(LEVELS if tiles else 0):
        found = middle(_counted).select("sid", *[F.array_append(r, F.col(c).cast("long")).alias(r) for r, c in (("low", "first"), ("high", "last"))], F.col("under").alias("before"), "pairs", "inside")
        ranges = kept(found, "kernel-ranges")
        if not ranges.where(F.col("inside") > FEW).count():
            break
    every = blocks.select("sid").distinct()
    if not tiles:
        return every.withColumn("width", F.lit(1.0))
    found = middle(_listed).select("sid", ((F.col("first") + F.col("last")) / 2).alias("d"))
    return every.join(found, "sid", "left").select("sid", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("width"))


def scan(x: np.ndarray, begin: int, width: float, penalty: float, least: int, first: float, value: np.ndarray, came: np.ndarray):
    """One block's step of the search: through its rows, from the starts within it and the best of those before it.

    first: the total up to ``begin``; value, came: for each end in the block, the least cost from a start before the block
    and that start. Returns where each end came from (-1: nowhere), the ends' totals, and of each start in the
    block its total, the kernel's sum over the square from it to the block's end, and whether it is still open.
    """
    n = len(x)
    totals, sums, alive = np.full(n + 1, np.inf), np.zeros(n), np.ones(n, bool)
    totals[0], came = first, np.where(np.isfinite(value), came, -1)
    for c in _columns(n):
        k = _kernel(x[: c.stop], x[c], width)
        for j in range(c.start, c.stop):
            sums[:j] += 2 * k[:j, j - c.start][::-1].cumsum()[::-1]  # over [start, row) of the block
            sums[: j + 1] += _DIAGONAL
            best, now = value[j], np.flatnonzero(alive[: max(j + 2 - least, 0)] & np.isfinite(totals[: max(j + 2 - least, 0)]))
            if len(now):
                size = j + 1 - now
                own = totals[now] + size * _DIAGONAL - sums[now] / size
                i = int(own.argmin())
                if own[i] < best:
                    best, came[j] = own[i], begin + now[i]
            totals[j + 1] = best + penalty
            if len(now):
                alive[now[own > totals[j + 1]]] = False
    return came, totals[1:], totals[:n], sums, alive & np.isfinite(totals[:n])


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sid, block, whole): the kernel between each row at hand and all rows of an earlier block; within one block, all rows before it."""
    for batch in batches:
        for sid, block, b, xs, nxs, ys, nys, width in zip(*(batch[c] for c in ("sid", "block", "b", "xs", "nxs", "ys", "nys", "width")), strict=True):
            x, y = _matrix(xs, nxs), _matrix(ys, nys)
            out = []
            for c in _columns(len(y)):
                k = _kernel(x, y[c], width)
                out.append((np.where(np.arange(len(x))[:, None] < np.arange(c.start, c.stop), k, 0.0) if block == b else k).sum(0))
            yield pd.DataFrame({"sid": [sid], "block": [block], "whole": [np.concatenate(out)]})


def _between(group: pd.DataFrame) -> pd.DataFrame:
    """(sid, block, between): the same for all that follows each earlier block, up to the row at hand."""
    group = group.sort_values("block", ascending=False)
    upto = np.cumsum(np.stack([np.asarray(w, float) for w in group["whole"]]), axis=0)
    return pd.DataFrame({"sid": group["sid"].iloc[1:], "block": group["block"].iloc[1:], "between": list(upto[:-1])})


def _cheapest(size: int, least: int):
    """(sid, block, value, came, totals, sums, alive): for each row at hand the least cost of a segment that starts in an earlier block, and the start.

    Starts end where their cost is over the known total (``known``; null: none is known) of a row. totals, sums, alive: the starts after the block at hand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, block, b, xs, nxs, ys, nys, width, totals, sums, alive, between, known in zip(*(batch[c] for c in ("sid", "block", "b", "xs", "nxs", "ys", "nys", "width", "totals", "sums", "alive", "between", "known")), strict=True):
                open_ = np.flatnonzero(np.asarray(alive, bool))
                x, y = _matrix(xs, nxs)[open_[0] :], _matrix(ys, nys)
                starts, total, square = block * size + open_, np.asarray(totals, float)[open_], np.asarray(sums, float)[open_]
                stays, value, came = np.ones(len(open_), bool), [], []
                for c in _columns(len(y)):
                    k = _kernel(x, y[c], width)
                    rows = k[::-1].cumsum(0)[::-1][open_ - open_[0]]
                    rows += np.asarray(between, float)[c]
                    rows *= 2
                    rows += _DIAGONAL
                    rows[:, 0] += square
                    np.cumsum(rows, axis=1, out=rows)
                    square = rows[:, -1].copy()
                    length = b * size + 1.0 + np.arange(c.start, c.stop) - starts[:, None]
                    rows /= length
                    cost = total[:, None] + length * _DIAGONAL
                    cost -= rows
                    if least > 1 and length[-1, 0] < least:
                        cost[length < least] = np.inf
                    if known is not None:
                        over = np.logical_or.accumulate(np.isfinite(cost) & (cost > np.asarray(known, float)[c]), axis=1)
                        cost[:, 1:][over[:, :-1]] = np.inf
                        cost[~stays] = np.inf
                        stays &= ~over[:, -1]
                    best = cost.argmin(0)
                    value.append(cost[best, np.arange(cost.shape[1])])
                    came.append(starts[best])
                after, left = np.zeros(int(nxs)), np.zeros(int(nxs), bool)
                after[open_], left[open_] = square, stays
                yield pd.DataFrame({"sid": [sid], "block": [block], "value": [np.concatenate(value)], "came": [np.concatenate(came)], "totals": [totals], "sums": [after], "alive": [left]})

    return run


def _scanned(size: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, b, ys, nys, width, penalty, first, before in zip(*(batch[c] for c in ("sid", "b", "ys", "nys", "width", "penalty", "first", "before")), strict=True):
                value, came = np.full(int(nys), np.inf), np.full(int(nys), -1)
                for t in sorted([] if before is None else list(before), key=lambda t: t["block"]):  # of equal costs the first start's counts
                    less = np.asarray(t["value"], float) < value
                    value, came = np.where(less, t["value"], value), np.where(less, t["came"], came)
                came, ends, totals, sums, alive = scan(_matrix(ys, nys), b * size, width, penalty, least, first, value, came)
                yield pd.DataFrame({"sid": [sid], "block": [b], "came": [came], "ends": [ends], "totals": [totals], "sums": [sums], "alive": [alive]})

    return run


def _still(size: int, least: int, block: int):
    """Of the starts before a block, those whose cost is not over the total there; blocks without any are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, b, totals, sums, alive, first in zip(*(batch[c] for c in ("sid", "block", "totals", "sums", "alive", "first")), strict=True):
                length = block * size - b * size - np.arange(len(totals))
                cost = np.asarray(totals, float) + length * _DIAGONAL - np.asarray(sums, float) / length
                alive = np.asarray(alive, bool) & ~((length >= least) & (cost > first))
                if alive.any():
                    yield pd.DataFrame({"sid": [sid], "block": [b], "totals": [totals], "sums": [sums], "alive": [alive]})

    return run


def _back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"sid": batch["sid"], "ends": [_ends(c) for c in batch["came"]]})


def _ends(came: np.ndarray) -> list[int]:
    ends = [len(came)]
    while came[ends[-1] - 1] > 0:
        ends.append(int(came[ends[-1] - 1]))
    return ends[::-1]


def _in_one_task(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in group.sort_values("i")["x"]])
        n, penalty = len(x), float(group["penalty"].iloc[0])
        came, *_ = scan(x, 0, _width(x), penalty, least, -penalty, np.full(n, np.inf), np.full(n, -1))
        return pd.DataFrame({"sid": [group["sid"].iloc[0]], "ends": [_ends(came)]})

    return run


_STATE = "totals array<double>, sums array<double>, alive array<boolean>"


def _by_blocks(rows: DataFrame, least: int, size: int, last: int) -> DataFrame:
    """(sid, ends) of long sequences, blocks 0 to ``last`` after each other."""
    parts = min((last + 1) * ABREAST, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    top = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    tops = rows.groupBy("sid").agg(F.max(top).alias("top"))
    blocks = rows.select("sid", "i", "x", "penalty", F.floor(F.col("i") / size).alias("block")).repartition(parts, "sid", "block")
    blocks = blocks.groupBy("sid", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"), F.max("penalty").alias("penalty"))
    blocks = kept(blocks.join(F.broadcast(tops), "sid"), "kernel-blocks")
    width = kept(widths(blocks), "kernel-widths")
    # A step adds at most 2 to a cost: with such a penalty a start that is over a row's total can't be the best at a later row, so it does no harm until the block ends.
    sure = not blocks.where(F.col("penalty") < 2 * (least - 1)).count()
    state, first, came = None, blocks.where("block = 0").select("sid", (-F.col("penalty")).alias("first")), []
    for b in range(last + 1):
        here = _flat(blocks.where(F.col("block") == b), "ys", "penalty").withColumnRenamed("block", "b").join(F.broadcast(width), "sid").join(F.broadcast(first), "sid")
        if state is not None:
            at_hand = F.broadcast(here.select("sid", "b", "ys", "nys", "width"))
            since = F.broadcast(state.groupBy("sid").agg(F.min("block").alias("since")))
            tiles = _flat(blocks.where(F.col("block") <= b), "xs").join(since, "sid").where("block >= since").drop("since").join(at_hand, "sid")
            whole = _each(tiles, ["sid", "block", "b"], _whole, "sid long, block long, whole array<double>")
            between = kept(whole.groupBy("sid").applyInPandas(_between, "sid long, block long, between array<double>"), "kernel-between")
            tiles = _flat(blocks.where(F.col("block") < b), "xs").join(F.broadcast(state), ["sid", "block"]).join(F.broadcast(between), ["sid", "block"]).join(at_hand, "sid")
        known, done = None, None
        while True:
            if state is None:
                before = None
                now = here.withColumn("before", F.lit(None).cast("array<struct<block:bigint,value:array<double>,came:array<bigint>>>"))
            else:
                with_known = tiles.withColumn("known", F.lit(None).cast("array<double>")) if known is None else tiles.join(F.broadcast(known), "sid")
                before = kept(_each(with_known, ["sid", "block", "b"], _cheapest(size, least), f"sid long, block long, value array<double>, came array<long>, {_STATE}"), "kernel-costs")
                now = here.join(F.broadcast(before.groupBy("sid").agg(F.collect_list(F.struct("block", "value", "came")).alias("before"))), "sid", "left")
            done = kept(_each(now, ["sid"], _scanned(size, least), f"sid long, block long, came array<long>, ends array<double>, {_STATE}"), "kernel-state")
            if sure or before is None or known is not None and not done.join(known, "sid").where(F.col("ends") != F.col("known")).count():
                break
            known = done.select("sid", F.col("ends").alias("known"))  # starts that end within the block: once more, until the totals stay
        came.append(done.select("sid", "block", "came"))
        first = done.select("sid", F.element_at("ends", -1).alias("first"))
        columns = ["sid", "block", "totals", "sums", "alive"]
        state = done.select(columns) if before is None else before.select(columns).unionByName(done.select(columns))
        state = state.join(F.broadcast(first), "sid").mapInPandas(_still(size, least, b + 1), f"sid long, block long, {_STATE}")
    every = reduce(DataFrame.unionByName, came).groupBy("sid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "came"))), lambda c: c["came"])).alias("came"))
    return kept(every.mapInPandas(_back, "sid long, ends array<int>"), "kernel-ends")


def change_points(rows: DataFrame, least: int, size: int = BLOCK) -> DataFrame:
    """(sid, ends): the ends of the segments of every sequence. rows: (sid, i, x, n, penalty), i from 0, x an array."""
    short = F.col("n") <= WHOLE * size
    found = rows.where(short).select("sid", "i", "x", "penalty").groupBy("sid").applyInPandas(_in_one_task(least), "sid long, ends array<int>")
    left = [tuple(r) for r in rows.where(~short & (F.col("i") == 0)).select("n", "sid", F.size("x")).sort(F.desc("n"), "sid").collect()]
    while left:
        longest = left[0][0]
        block = max(size, min(-(-longest // STEPS), LONGEST))
        some = max(min(ABREAST, PANEL // (block * max(left[0][2], 1))), 1)
        now, left = left[:some], left[some:]
        found = found.unionByName(_by_blocks(rows.where(F.col("sid").isin([sid for _, sid, _ in now])), least, block, (longest - 1) // block))
    return found
