"""Choosing positions and rows: strides, even spreads, budgets, hashed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.scalars import budget, linspace_kept, linspace_positions


def position(keys: list[str], order: list[str]) -> Column:
    """0-based place within ``keys`` in ``order``."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def strided(frames: DataFrame, stride: int, start: int = 0, end: int | None = None, frame: str = "frame_idx") -> DataFrame:
    """Every ``stride``-th frame from ``start``, up to and with ``end``; plain comparisons, so they reach the scan."""
    rows = frames.where(F.col(frame) >= start)
    if end is not None:
        rows = rows.where(F.col(frame) <= end)
    return rows.where(F.pmod(F.col(frame) - start, F.lit(stride)) == 0)


def stride_and_cap(frames: DataFrame, keys: list[str], order: list[str], stride: int = 1, cap: int = 0) -> DataFrame:
    """Every ``stride``-th row of each group, thinned to ``cap`` evenly spread ones (0: all)."""
    rows = frames.withColumn("__p", position(keys, order)).where(F.pmod("__p", F.lit(stride)) == 0)
    rows = rows.withColumn("__i", F.floor(F.col("__p") / stride).cast("int"))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
    return rows.where(linspace_kept(F.col("__i"), F.col("__n"), cap)).drop("__p", "__i", "__n")


def uniform(videos: DataFrame, m: int, total: str = "total_frames") -> DataFrame:
    """``m`` evenly spread frames of each video."""
    at = F.explode(linspace_positions(F.col(total), m)).alias("frame_idx")
    return videos.select(*[c for c in videos.columns if c != total], at)


def middle_of_scene(scenes: DataFrame, videos: DataFrame, m: int, video: str = "video_id") -> DataFrame:
    """The middles of a video's scenes, thinned evenly to ``m``; where there are fewer, filled up with evenly spread frames. Repeats stay."""
    mid = F.floor((F.col("start_frame") + F.col("end_frame")) / 2)
    mids = scenes.groupBy(video).agg(F.sort_array(F.collect_list(F.struct("start_frame", mid.alias("m")))).alias("x"), F.min("start_frame").alias("lo"), F.max("end_frame").alias("hi"))
    mids = videos.select(video).join(mids, video, "left").where("x IS NOT NULL")
    x = F.transform("x", lambda s: s["m"])
    n = F.size("x")
    thinned = F.transform(linspace_positions(n, m), lambda i: F.get(x, i.cast("int")))
    span = F.col("hi") - F.col("lo") + 1
    extra = F.transform(linspace_positions(span, F.lit(m) - n), lambda i: F.col("lo") + i)
    chosen = F.array_sort(F.when(n >= m, thinned).otherwise(F.concat(x, extra)))
    return mids.select(video, F.explode(chosen).alias("frame_idx"))


def top_budget(rows: DataFrame, keys: list[str], prob: str, order: str, ratio: float, least: int, most: int) -> DataFrame:
    """The most probable rows of each group, as many as its budget allows; ties by order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(prob).desc(), order))
    return rows.withColumn("__r", rank).withColumn("__b", budget(ratio, n, least, most)).where("__r <= __b").drop("__r", "__b")


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only ``n`` of a group before the exchange."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def hashed(*parts: Column | str | int) -> Column:
    """A hash of the parts as text."""
    return F.md5(F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def hashed_sample(rows: DataFrame, keys: list[str], by: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each group without replacement, by the order of a hash: the same on each run and in other engines."""
    return top(rows, keys, [hashed(seed, *by), *[F.col(c) for c in by]], n)


def hashed_pairs(rows: DataFrame, keys: list[str], order: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` pairs (i < j) of positions in each group, by the order of a hash."""
    from reelspark.operators.distance import pairs

    p = pairs(rows, keys, order)
    return hashed_sample(p, keys, ["i", "j"], n, seed)


def shuffled(rows: DataFrame, by: list[str], epoch: int, seed: int = 0) -> DataFrame:
    """``rows`` with a place to be visited at in this epoch: the order of a hash, another one for each epoch and seed."""
    return rows.withColumn("visit", hashed(seed, epoch, *by))


def limited(frames: DataFrame, keys: list[str], order: str, most: int | None) -> DataFrame:
    """The first ``most`` frames of each group in order; all without a limit."""
    return frames if most is None else top(frames, keys, [F.col(order)], most)


#: Ranges of values by which rows are counted.
RANGES = 512


def global_position(rows: DataFrame, value: str, ties: list[str], out: str) -> DataFrame:
    """0-based place of each row in the order of a number, then ``ties``; nulls first.

    Rows are numbered within ranges of the value, whose bounds are percentiles, and ranges are counted:
    no window has all rows, unless all are of one value.
    """
    x = F.col(value).cast("double")
    bounds = rows.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<double>")
    held = rows.withColumn("__range", F.when(x.isNull(), -1).otherwise(F.size(F.filter(edges, lambda b: b < x))))
    counts = held.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("__range", before.alias("__before"))  # RANGES + 1 rows at most
    place = F.row_number().over(Window.partitionBy("__range").orderBy(value, *ties)) - 1
    return held.withColumn("__place", place).join(F.broadcast(firsts), "__range").withColumn(out, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")
