"""Whole runs as single plans over all videos: choose keys, judge them against baselines, search settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import vectors as V
from reelspark.operators import metrics, sampling, scenes, selection
from reelspark.sources.shared import kept


def scene_table(boundaries: DataFrame, videos: DataFrame, least: int, video: str = "video_id") -> DataFrame:
    """Boundaries to scenes, short ones merged, whole videos where none was found; numbered and described. videos: (video, total_frames, fps)."""
    cut = scenes.merge_short(scenes.from_boundaries(boundaries, videos, video), least, video)
    cut = scenes.numbered(scenes.or_whole_video(cut, videos, video), video)
    return scenes.described(cut.join(videos.select(video, "fps"), video))


def choose(frames: DataFrame, keys: list[str], pos: str, vector: str, method: str = "medoid", stride: int = 1, cap: int = 30, k: int = 1, radius: int = 0, metric: str = "cosine", seed: int = 0) -> DataFrame:
    """(keys, pos, score) of the chosen frames of every scene: sampled before the pairs are formed."""
    some = sampling.stride_and_cap(frames, keys, [pos], stride, cap)
    if method == "medoid":
        return selection.medoids(some, keys, pos, vector, k, radius, metric)
    if method == "random":
        return selection.random_picks(some, keys, pos, k, radius, seed).withColumn("score", F.lit(0.0))
    raise ValueError(f"method is medoid or random, not {method!r}")


def evaluate(frames: DataFrame, chosen: dict[str, DataFrame], keys: list[str], pos: str, vector: str, tau: float = 0.3) -> DataFrame:
    """(keys, method, n_keys, rec_error, temporal_coverage, redundancy, min_distance, diversity) of every method in one plan.

    chosen: (keys, pos) for each method; keys outside the frames are snapped to them. Frames with a
    NaN in their vector are left out first.
    """
    frames = frames.where(~V.has_nan(V.doubles(vector)))
    # Written once: what chooses the keys would run again for each measure.
    raw = kept(reduce(DataFrame.unionByName, [c.select(*keys, F.col(pos).cast("long").alias(pos)).withColumn("method", F.lit(m)) for m, c in chosen.items()]), "keys")
    sampled = reduce(DataFrame.unionByName, [frames.select(*keys, pos).withColumn("method", F.lit(m)) for m in chosen])
    by = [*keys, "method"]
    snapped = metrics.snapped_keys(raw, sampled, by, pos)
    with_vector = kept(snapped.join(frames.select(*keys, pos, vector), [*keys, pos]).withColumnRenamed(pos, "key_idx"), "key-vectors")
    near = metrics.nearest_key_metrics(frames, with_vector, keys, pos, vector, tau, also=("method",))
    spread = metrics.redundancy(with_vector, by, "key_idx", vector)
    n = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"))
    return n.join(near, by, "left").join(spread, by, "left")
