"""One-dimensional signals over ordered rows: changes, filters, boundary scores, peaks, pooling, averages.

Long form (keys, t, value) with t = 0, 1, ...; a padded window is a window over rows to which the
copies at both ends are added, so no sequence is gathered into one array.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import vectors as V


def adjacent_cosine(rows: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """1 - cosine of each row and the next; a row less than the input."""
    v = V.doubles(vector)
    following = F.lead(v).over(Window.partitionBy(*keys).orderBy(order))
    r = rows.select(*keys, order, v.alias("__a"), following.alias("__b")).where("__b IS NOT NULL")
    return r.select(*keys, order, (1 - V.cosine(F.col("__a"), F.col("__b"))).alias("delta"))


def change_hints(rows: DataFrame, keys: list[str], order: str, ident: str) -> DataFrame:
    """1 where the next row has another identifier, else 0; none for the last row."""
    following = F.lead(ident).over(Window.partitionBy(*keys).orderBy(order))
    r = rows.select(*keys, order, ident, following.alias("__n"), F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(order)).alias("__m")).where("__m = 1")
    return r.select(*keys, order, F.when(F.col(ident).eqNullSafe(F.col("__n")), 0.0).otherwise(1.0).alias("hint"))


def robust_delta(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Absolute change to the next row, less its median over 1.4826 median deviations, between 0 and 6."""
    by = Window.partitionBy(*keys)
    r = rows.select(*keys, order, F.abs(F.lead(value).over(by.orderBy(order)) - F.col(value)).alias("__d")).where("__d IS NOT NULL")
    r = r.withColumn("__m", F.median("__d").over(by))
    r = r.withColumn("__mad", F.median(F.abs(F.col("__d") - F.col("__m"))).over(by) + 1e-8)
    return r.select(*keys, order, V.clip((F.col("__d") - F.col("__m")) / (1.4826 * F.col("__mad") + 1e-8), 0.0, 6.0).alias("delta"))


def _padded(rows: DataFrame, keys: list[str], order: str, value: str, half: int, reflect: bool) -> DataFrame:
    """(keys, order, x, n, i, own): the rows numbered by i from 0, and ``half`` copies beyond each end: of the end row, or reflected at it."""
    by = Window.partitionBy(*keys)
    r = rows.select(*keys, order, F.col(value).cast("double").alias("__x"), F.count(F.lit(1)).over(by).alias("__n"), (F.row_number().over(by.orderBy(order)) - 1).alias("__i"))
    i, last = F.col("__i"), F.col("__n") - 1
    steps = F.array(*[F.lit(k) for k in range(1, half + 1)])
    if reflect:
        before, after = F.filter(F.array(-i), lambda p: (i >= 1) & (i <= half)), F.filter(F.array(2 * last - i), lambda p: (i < last) & (i >= last - half))
    else:
        before, after = F.when(i == 0, F.transform(steps, lambda k: -k)), F.when(i == last, F.transform(steps, lambda k: last + k))
    none = F.array().cast("array<bigint>")
    places = F.concat(F.array(i.cast("bigint")), F.coalesce(before.cast("array<bigint>"), none), F.coalesce(after.cast("array<bigint>"), none))
    return r.select(*keys, order, "__x", "__n", "__i", F.explode(places).alias("__at")).withColumn("__own", F.col("__at") == F.col("__i"))


def median_filter(rows: DataFrame, keys: list[str], order: str, value: str, k: int = 5) -> DataFrame:
    """Median of ``k`` neighbours, the ends repeated; unchanged where the sequence is shorter than ``k``, or k is 1."""
    half = k // 2
    r = _padded(rows, keys, order, value, half, False)
    near = F.array_sort(F.collect_list("__x").over(Window.partitionBy(*keys).orderBy("__at").rowsBetween(-half, half)))
    n = F.size("__near")
    middle = (F.get("__near", F.floor((n - 1) / 2).cast("int")) + F.get("__near", F.floor(n / 2).cast("int"))) / 2
    out = F.when((F.col("__n") < k) | F.lit(k <= 1), F.col("__x")).otherwise(middle)
    return r.withColumn("__near", near).where("__own").select(*keys, order, out.alias(value))


def local_zscore(rows: DataFrame, keys: list[str], order: str, value: str, window: int = 11) -> DataFrame:
    """Deviation from the mean of ``window`` neighbours in their standard deviations, at least 0; the ends are reflected.

    Unchanged where the sequence is shorter than the window, or the window is 3 or less.
    """
    half = window // 2
    r = _padded(rows, keys, order, value, half, True)
    near = Window.partitionBy(*keys).orderBy("__at").rowsBetween(-half, half)
    z = F.greatest((F.col("__x") - F.col("__mean")) / (F.col("__spread") + 1e-8), F.lit(0.0))
    out = F.when((F.col("__n") < window) | F.lit(window <= 3), F.col("__x")).otherwise(z)
    return r.select("*", F.avg("__x").over(near).alias("__mean"), F.stddev_pop("__x").over(near).alias("__spread")).where("__own").select(*keys, order, out.alias(value))


def min_max(rows: DataFrame, keys: list[str], value: str, out: str, eps: float = 1e-8) -> DataFrame:
    by = Window.partitionBy(*keys)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return rows.withColumn(out, (F.col(value) - low) / (high - low + eps))


def standardized(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Less the mean, over the standard deviation; a constant sequence over 1."""
    by = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(by)
    return rows.withColumn(out, (F.col(value) - F.avg(value).over(by)) / F.when(sd == 0, 1.0).otherwise(sd))


def boundary_score(rows: DataFrame, keys: list[str], order: str, vector: str, quality: str, ident: str | None = None, w_vector: float = 0.8, w_quality: float = 0.2, hint: float = 0.15) -> DataFrame:
    """(keys, order, score): how much each row parts from the next, 0 to 1 over the sequence.

    Weighted change of vectors and of the standardized quality; median filter; 0.7 of it plus 0.3 of
    its local z-score; a bonus where the identifier changes; min-max.
    """
    on = [*keys, order]
    a = adjacent_cosine(rows, keys, order, vector)
    b = robust_delta(standardized(rows, keys, quality, "__q"), keys, order, "__q").withColumnRenamed("delta", "__dq")
    s = a.join(b, on).select(*on, (w_vector * F.col("delta") + w_quality * F.col("__dq")).alias("b"))
    s = median_filter(s, keys, order, "b", 5)
    s = s.join(local_zscore(s, keys, order, "b", 11).withColumnRenamed("b", "__z"), on).select(*on, (0.7 * F.col("b") + 0.3 * F.col("__z")).alias("b"))
    if ident:
        s = s.join(change_hints(rows, keys, order, ident), on).select(*on, (F.col("b") + hint * F.col("hint")).alias("b"))
    return min_max(s, keys, "b", "score").select(*on, "score")


def filled_tail(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A last row without a value repeats the one before."""
    by = Window.partitionBy(*keys).orderBy(order)
    last = F.lead(F.lit(1)).over(by).isNull()
    return rows.withColumn(value, F.when(last, F.coalesce(value, F.lag(value).over(by))).otherwise(F.col(value)))


def local_extrema(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows above (peak) or below (valley) both neighbours."""
    by = Window.partitionBy(*keys).orderBy(order)
    x, a, b = F.col(value), F.lag(value).over(by), F.lead(value).over(by)
    kind = F.when((x > a) & (x > b), "peak").when((x < a) & (x < b), "valley")
    return rows.select(*keys, order, value, kind.alias("kind")).where("kind IS NOT NULL")


#: Rows of a block of a sequence, in the search for higher rows.
BLOCK_ROWS = 1024


def _tops(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, p, y) of numbered rows (keys, i, x): the middles of runs above (y = x) or, for valleys (y = -x), below both neighbouring runs."""
    by = Window.partitionBy(*keys).orderBy("i")
    r = rows.withColumn("new", F.coalesce((F.col("x") != F.lag("x").over(by)).cast("int"), F.lit(0)))
    r = r.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.groupBy(*keys, "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("x").alias("x"))
    runs = Window.partitionBy(*keys).orderBy("run")
    before, after = F.lag("x").over(runs), F.lead("x").over(runs)
    kind = F.when((before < F.col("x")) & (after < F.col("x")), "peak").when((before > F.col("x")) & (after > F.col("x")), "valley")
    r = r.withColumn("kind", kind).where("kind IS NOT NULL")
    return r.select(*keys, "kind", F.floor((F.col("a") + F.col("b")) / 2).alias("p"), F.when(F.col("kind") == "peak", F.col("x")).otherwise(-F.col("x")).alias("y"))


def _thinned(tops: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """``tops`` without those nearer than ``distance`` to one that is kept, from the highest down, later ones first on ties.

    What is kept depends on a chain of near ones alone, so each chain is a row, and a task has many.
    """
    if distance <= 1:
        return tops
    by = Window.partitionBy(*keys, "kind").orderBy("p")
    apart = F.coalesce((F.col("p") - F.lag("p").over(by) >= distance).cast("int"), F.lit(0))
    chains = tops.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chains.groupBy(*keys, "kind", "chain").agg(F.sort_array(F.collect_list(F.struct("y", "p")), asc=False).alias("tops"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chains.drop("tops", "chain").schema.fields)

    def keep(batches):
        for batch in batches:
            out = []
            for tops_ in batch["tops"]:
                kept: list[int] = []
                for t in tops_:
                    at = bisect.bisect(kept, t["p"])
                    if (at == 0 or t["p"] - kept[at - 1] >= distance) and (at == len(kept) or kept[at] - t["p"] >= distance):
                        kept.insert(at, t["p"])
                out.append([t for t in tops_ if t["p"] in set(kept)])
            yield batch[[*keys, "kind"]].assign(tops=out)

    return chains.drop("chain").mapInPandas(keep, f"{fields}, tops array<struct<y:double,p:long>>").select(*keys, "kind", F.inline("tops")).select(*keys, "kind", "p", "y")


def _sides(x: np.ndarray, at: int, y: float) -> tuple[float, float, bool, bool]:
    """Of a block's values: the least between a place and the nearest higher one on its left and right, and whether there is one."""
    left, right = np.flatnonzero(x[:at] > y), np.flatnonzero(x[at + 1 :] > y)
    low = lambda part: float(part.min()) if len(part) else math.inf
    return low(x[left[-1] + 1 if len(left) else 0 : at]), low(x[at + 1 : at + 1 + right[0] if len(right) else len(x)]), bool(len(left)), bool(len(right))


def _prominences(rows: DataFrame, tops: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``tops`` with ``prominence``: how far each stands above the higher of the least values between it and the next higher row on either side.

    A sequence is cut into blocks. Each block looks for higher rows in itself, then in the other blocks' highest and
    lowest values; the block where the next higher row must be is asked in a second step.
    """
    blocks = rows.withColumn("block", F.floor(F.col("i") / size)).groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))
    ends = blocks.select(*keys, F.struct("block", F.array_max("xs").alias("high"), F.array_min("xs").alias("low")).alias("end")).groupBy(*keys).agg(F.array_sort(F.collect_list("end")).alias("ends"))
    asked = tops.withColumn("block", F.floor(F.col("p") / size)).groupBy(*keys, "block").agg(F.collect_list(F.struct("kind", "p", "y")).alias("tops"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tops.select(*keys).schema.fields)

    def own(batches):
        for batch in batches:
            out = []
            for *key, block, xs, ends_, tops_ in zip(*(batch[c] for c in (*keys, "block", "xs", "ends", "tops")), strict=True):
                values, high, low = np.asarray(xs, float), np.array([e["high"] for e in ends_]), np.array([e["low"] for e in ends_])
                for t in tops_:
                    peak = t["kind"] == "peak"
                    tall, deep = (high, low) if peak else (-low, -high)
                    left, right, l_done, r_done = _sides(values if peak else -values, t["p"] - block * size, t["y"])
                    targets = [None, None]
                    if not l_done:
                        over = np.flatnonzero(tall[:block] > t["y"])
                        targets[0] = int(over[-1]) if len(over) else None
                        left = min(left, float(deep[(over[-1] + 1 if len(over) else 0) : block].min(initial=math.inf)))
                    if not r_done:
                        over = np.flatnonzero(tall[block + 1 :] > t["y"]) + block + 1
                        targets[1] = int(over[0]) if len(over) else None
                        right = min(right, float(deep[block + 1 : over[0] if len(over) else len(deep)].min(initial=math.inf)))
                    out.append((*key, t["kind"], t["p"], t["y"], left, right, *targets))
            yield pd.DataFrame(out, columns=[*keys, "kind", "p", "y", "left", "right", "to0", "to1"]).astype({"to0": "Int64", "to1": "Int64"})

    found = blocks.join(ends, keys).join(asked, [*keys, "block"]).mapInPandas(own, f"{fields}, kind string, p long, y double, left double, right double, to0 long, to1 long")
    on = [*keys, "kind", "p", "y"]
    sides = found.select(*on, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(low).alias("low"), F.col(f"to{i}").alias("to")) for i, low in enumerate(("left", "right"))])).alias("s")).select(*on, "s.*")
    there = sides.where("to IS NOT NULL").groupBy(*keys, F.col("to").alias("block")).agg(F.collect_list(F.struct("kind", "p", "y", "side", "low")).alias("tops"))

    def other(batches):
        for batch in batches:
            out = []
            for *key, xs, tops_ in zip(*(batch[c] for c in (*keys, "xs", "tops")), strict=True):
                values = np.asarray(xs, float)
                for t in tops_:
                    x = values if t["kind"] == "peak" else -values
                    part = _sides(x, len(x), t["y"])[0] if t["side"] == 0 else _sides(x, -1, t["y"])[1]
                    out.append((*key, t["kind"], t["p"], t["y"], t["side"], min(t["low"], part)))
            yield pd.DataFrame(out, columns=[*keys, "kind", "p", "y", "side", "low"])

    settled = there.join(blocks, [*keys, "block"]).mapInPandas(other, f"{fields}, kind string, p long, y double, side int, low double")
    every = sides.where("to IS NULL").select(*on, "side", "low").unionByName(settled.select(*on, "side", "low"))
    low = every.groupBy(*on).agg(F.max(F.least("low", "y")).alias("base"))
    return low.select(*on, (F.col("y") - F.col("base")).alias("prominence"))


#: Fixed value: a score stands for the frame so many after its place: the first compares frame 2 with frame 1.
FRAME_OF_SCORE = 2


def peaks_and_valleys(rows: DataFrame, keys: list[str], order: str, value: str, prominence: float = 0.05, distance: int = 5, most: int = 100, block: int = BLOCK_ROWS) -> DataFrame:
    """(keys, order, frame, value, kind, prominence): prominent peaks and valleys, the ``most`` most prominent of both.

    Of equally prominent ones the earlier goes first; a peak before a valley. Rows without a value are left out.
    A sequence is spread over tasks by blocks of ``block`` rows.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    r = rows.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("x"), place.cast("long").alias("i"))
    found = _prominences(r.select(*keys, "i", "x"), _thinned(_tops(r.select(*keys, "i", "x"), keys), keys, distance), keys, block).where(F.col("prominence") >= prominence)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prominence"), "p", "kind"))
    found = found.withColumn("best", best).where(F.col("best") <= most).select(*keys, F.col("p").alias("i"), "kind", "prominence")
    return found.join(r, [*keys, "i"]).select(*keys, order, (F.col("i") + FRAME_OF_SCORE).alias("frame"), F.col("x").alias("value"), "kind", "prominence")


def analyzer_summary(rows: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, min, max, n_keyframes, n_peaks, n_valleys) of scores and the extrema found in them."""
    scores = rows.groupBy(*keys).agg(F.avg(value).alias("mean_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"))
    kinds = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_keyframes"), F.count_if(F.col("kind") == "peak").alias("n_peaks"), F.count_if(F.col("kind") == "valley").alias("n_valleys"))
    return scores.join(kinds, keys, "left").na.fill(0, ["n_keyframes", "n_peaks", "n_valleys"])


def block_pool(rows: DataFrame, keys: list[str], order: str, value: str, scale: int) -> DataFrame:
    """Mean of maximum and average of each block of 2**scale steps; a tail block goes; shorter sequences stay as they are."""
    size = 1 << scale
    r = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    t = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    r = r.withColumn("block", F.when(F.col("__n") < size, t).otherwise(F.floor(t / size)).cast("long"))
    pooled = r.groupBy(*keys, "block").agg(((F.max(value) + F.avg(value)) / 2).alias("pooled"), F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    return pooled.where((F.col("__c") == size) | (F.col("__n") < size)).select(*keys, "block", "pooled")


def upsampled(pooled: DataFrame, keys: list[str], n: Column | int, out: str = "value") -> DataFrame:
    """Blocks back to ``n`` steps by linear interpolation between the blocks' centres."""
    g = pooled.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "pooled"))), lambda s: s["pooled"]).alias("__p"))
    n = F.lit(n) if not isinstance(n, Column) else n
    m = F.size("__p")
    at = lambda t: V.clip((t + 0.5) * m / n - 0.5, F.lit(0.0), (m - 1).cast("double"))
    value = lambda t: F.get("__p", F.floor(at(t)).cast("int")) + (at(t) - F.floor(at(t))) * (F.get("__p", F.ceil(at(t)).cast("int")) - F.get("__p", F.floor(at(t)).cast("int")))
    return g.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), value)).alias("t", out))


def ema(rows: DataFrame, keys: list[str], order: str, value: str, beta: float = 0.9) -> DataFrame:
    """b = beta * b + (1 - beta) * x, from the first x on.

    In closed form by blocks, in windows: within a block the sum of x over powers of beta; of the past,
    only the block before counts, since a block is as long as beta takes to fall below 1e-18.
    """
    if not 0 < beta < 1:
        return rows.select(*keys, order, (F.col(value) if beta == 0 else F.first(value).over(Window.partitionBy(*keys).orderBy(order))).cast("double").alias("ema"))
    size = math.ceil(math.log(1e-18) / math.log(beta))
    t = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    r = rows.select(*keys, order, F.col(value).cast("double").alias("__x"), t.alias("__t"))
    r = r.withColumns({"__b": F.floor(F.col("__t") / size), "__j": F.pmod("__t", F.lit(size))})
    weight = F.when(F.col("__t") == 0, 1.0).otherwise(1 - beta)
    block = Window.partitionBy(*keys, "__b").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    own = F.pow(F.lit(beta), F.col("__j")) * F.sum(weight * F.col("__x") * F.pow(F.lit(beta), -F.col("__j"))).over(block)
    r = r.withColumn("__own", own)
    ends = F.when(F.col("__j") == size - 1, F.col("__own"))
    last = F.last(ends, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    return r.select(*keys, order, (F.col("__own") + F.coalesce(F.pow(F.lit(beta), F.col("__j") + 1) * last, F.lit(0.0))).alias("ema"))


def running_best(rows: DataFrame, keys: list[str], order: str, value: str, patience: int) -> DataFrame:
    """Best value so far, and ``stops`` from where the last ``patience`` bests are the same (and one more came before)."""
    by = Window.partitionBy(*keys).orderBy(order)
    r = rows.withColumn("best", F.max(value).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__i", F.row_number().over(by))
    flat = (F.lag("best", patience - 1).over(by) == F.col("best")) & (F.col("__i") >= patience + 1)
    return r.withColumn("stops", F.coalesce(flat, F.lit(False))).drop("__i")


def stop_at(rows: DataFrame, keys: list[str], order: str, value: str, patience: int) -> DataFrame:
    """The first step at which a search would stop; null if it runs to its end."""
    r = running_best(rows, keys, order, value, patience)
    return r.groupBy(*keys).agg(F.min(F.when(F.col("stops"), F.col(order))).alias("stop_at"), F.max("best").alias("best"))
