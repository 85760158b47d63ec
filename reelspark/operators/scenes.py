"""Scenes: closed intervals of frames; all rules are windows over ordered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.names import Named
from reelspark.functions.scalars import duration_frames, duration_seconds, frames_to_timecode


def from_boundaries(boundaries: DataFrame, videos: DataFrame, video: str = "video_id", frame: str = "frame_idx", total: str = "total_frames") -> DataFrame:
    """Scenes that end at the boundary frames; a tail scene follows the last one.

    A boundary right behind an accepted one opens no scene, so in a run of neighbours every other
    one counts: the even ones of the run, or the odd ones where the run starts at frame 0.
    """
    by = Window.partitionBy(video).orderBy(frame)
    b = boundaries.select(video, frame).distinct()
    b = b.withColumn("__new", (F.col(frame) - F.lag(frame).over(by) != 1) | F.lag(frame).over(by).isNull())
    b = b.withColumn("__run", F.sum(F.col("__new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(video, "__run")
    b = b.withColumn("__first", F.min(frame).over(run))
    b = b.where(F.pmod(F.col(frame) - F.col("__first"), F.lit(2)) == F.when(F.col("__first") == 0, 1).otherwise(0))
    cuts = b.select(video, F.coalesce(F.lag(frame).over(by) + 1, F.lit(0)).cast("long").alias("start_frame"), F.col(frame).cast("long").alias("end_frame"))
    last = cuts.groupBy(video).agg(F.max("end_frame").alias("__last"))
    tail = videos.select(video, total).join(last, video, "left").select(video, (F.coalesce("__last", F.lit(-1)) + 1).cast("long").alias("start_frame"), (F.col(total) - 1).cast("long").alias("end_frame"))
    return cuts.unionByName(tail.where("start_frame <= end_frame"))


def cuts_above(probabilities: DataFrame, threshold: float = 0.5, p: str = "p") -> DataFrame:
    """Frames whose boundary probability is above the threshold."""
    return probabilities.where(F.col(p) > threshold)


def ordered_bounds(scenes: DataFrame) -> DataFrame:
    """Reversed bounds turned round."""
    return scenes.withColumns({"start_frame": F.least("start_frame", "end_frame"), "end_frame": F.greatest("start_frame", "end_frame")})


def merge_short(scenes: DataFrame, least: int, video: str = "video_id") -> DataFrame:
    """Scenes in order, each of under ``least`` frames taken up by the one before; the first is never taken up."""
    s = ordered_bounds(scenes).select(video, "start_frame", "end_frame")
    by = Window.partitionBy(video).orderBy("start_frame", "end_frame")
    opens = (F.row_number().over(by) == 1) | (F.col("end_frame") - F.col("start_frame") + 1 >= least)
    s = s.withColumn("__g", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(video, "__g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("__g")


def numbered(scenes: DataFrame, video: str = "video_id") -> DataFrame:
    return scenes.withColumn("scene_id", F.row_number().over(Window.partitionBy(video).orderBy("start_frame", "end_frame")) - 1)


def or_whole_video(scenes: DataFrame, videos: DataFrame, video: str = "video_id", total: str = "total_frames") -> DataFrame:
    """A video without scenes is one scene."""
    s = scenes.select(video, "start_frame", "end_frame")
    end = F.coalesce("end_frame", F.greatest(F.col(total) - 1, F.lit(0)))
    return videos.select(video, total).join(s, video, "left").select(video, F.coalesce("start_frame", F.lit(0)).alias("start_frame"), end.alias("end_frame"))


def clamped(scenes: DataFrame, low: Column, high: Column, least: int = 2) -> DataFrame:
    """Scenes cut to [low, high]; what is reversed or shorter than ``least`` goes."""
    s = scenes.withColumns({"start_frame": F.greatest("start_frame", low), "end_frame": F.least("end_frame", high)})
    return s.where((F.col("end_frame") >= F.col("start_frame")) & (F.col("end_frame") - F.col("start_frame") + 1 >= least))


def from_seconds(times: DataFrame, start: str = "start_sec", end: str = "end_sec", fps: str = "fps") -> DataFrame:
    """Half-open times to closed frames; at least one frame."""
    first = F.floor(F.col(start) * F.col(fps))
    return times.withColumns({"start_frame": first, "end_frame": F.greatest(F.floor(F.col(end) * F.col(fps)) - 1, first)})


def fixed_length(videos: DataFrame, length: int, total: str = "total_frames") -> DataFrame:
    """Scenes of ``length`` frames, the last one what is left."""
    starts = F.when(F.col(total) > 0, F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1, F.lit(length).cast("long"))).otherwise(F.array().cast("array<long>"))
    rows = videos.select("*", F.explode(starts).alias("start_frame"))
    return rows.withColumn("end_frame", F.least(F.col("start_frame") + length - 1, F.col(total) - 1)).drop(total)


def described(scenes: DataFrame, fps: str = "fps") -> DataFrame:
    """Scenes with time codes and durations."""
    s, e, r = F.col("start_frame"), F.col("end_frame"), F.col(fps)
    return scenes.withColumns({"start_time": frames_to_timecode(s, r), "end_time": frames_to_timecode(e, r), "duration_frames": duration_frames(s, e), "duration_seconds": duration_seconds(s, e, r)})


def frames_in_scenes(frames: DataFrame, scenes: DataFrame, keys: list[str], frame: str = "frame_idx", block: int = 1024) -> DataFrame:
    """Frames joined with the scenes that hold them, both ends included.

    An equi-join on blocks of frames: a scene has a row for each block that it touches, so the
    join needs neither a nested loop nor a broadcast.
    """
    s = scenes.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_frame") / block), F.floor(F.col("end_frame") / block))))
    f = frames.withColumn("__b", F.floor(F.col(frame) / block))
    joined = f.join(s, [*keys, "__b"]).where(F.col(frame).between(F.col("start_frame"), F.col("end_frame")))
    return joined.drop("__b")


def covered(scenes: DataFrame, keys: DataFrame, by: list[str], frame: str = "frame_idx") -> DataFrame:
    """Scenes with ``covered``: whether a key lies in it. Each scene looks at the first key from its start on."""
    k = keys.select(*by, F.col(frame).alias("start_frame"), F.lit(1).alias("__k"), F.col(frame).alias("__at"))
    rows = scenes.withColumns({"__k": F.lit(0), "__at": F.lit(None).cast("long")}).unionByName(k, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(F.col("start_frame").desc(), F.col("__k").desc())
    following = F.last("__at", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__next", following).where("__k = 0").withColumn("covered", F.coalesce(F.col("__next") <= F.col("end_frame"), F.lit(False))).drop("__k", "__at", "__next")


def with_keyframes(scenes: DataFrame, keyframes: DataFrame, keys: list[str], frame: str = "frame_idx") -> DataFrame:
    """A row for each scene and key in it, and one with a null key for a scene that has none; with the number of the scene's keys."""
    k = keyframes.select(*keys, frame).distinct()
    out = scenes.join(k, keys, "left")
    return out.withColumn("n_keys", F.count(frame).over(Window.partitionBy(*keys)))


#: A detector turns (video, total_frames) and boundary probabilities (video, frame_idx, p) into scenes.
Detector = Callable[..., DataFrame]


def by_threshold(videos: DataFrame, probabilities: DataFrame, threshold: float = 0.5, video: str = "video_id") -> DataFrame:
    return from_boundaries(cuts_above(probabilities, threshold), videos, video)


def by_length(videos: DataFrame, probabilities: DataFrame | None = None, length: int = 100, video: str = "video_id") -> DataFrame:
    return fixed_length(videos.select(video, "total_frames"), length)


DETECTORS: Named[Detector] = Named("detector", threshold=by_threshold, fixed=by_length)
