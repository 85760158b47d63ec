"""Scalar rules: time codes, budgets, parsing of names, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.vectors import clip


def known(x: Column) -> Column:
    """x, or null where it is NaN."""
    return F.when(~F.isnan(x), x)


def or_zero(x: Column) -> Column:
    return F.coalesce(known(x), F.lit(0.0))


def frame_ms(frame: Column, fps: Column) -> Column:
    """Milliseconds of a frame, rounded half up; a rate below one frame a second counts as one."""
    return F.round(frame * 1000.0 / F.greatest(fps, F.lit(1.0)), 0).cast("long")


def timecode(ms: Column) -> Column:
    """HH:MM:SS.mmm with carries in integers, so no 60 seconds and no 1000 milliseconds are shown."""
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0") + F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def frames_to_timecode(frame: Column, fps: Column) -> Column:
    return timecode(frame_ms(frame, fps))


def timecode_or_zero(frame: Column, fps: Column) -> Column:
    """As above, but 00:00:00.000 where there is no rate."""
    return F.when(fps <= 0, F.lit("00:00:00.000")).otherwise(timecode(F.round(frame * 1000.0 / fps, 0).cast("long")))


def rate_or_default(fps: Column, default: float = 30.0) -> Column:
    return F.when(fps.isNull() | (fps <= 1e-6), F.lit(default)).otherwise(fps)


def keep_every(source_fps: Column, fps: float, stride: int) -> Column:
    """Every how many frames one is kept."""
    by_rate = F.greatest(F.lit(1), F.bround(source_fps / fps, 0).cast("int")) if fps > 0 else F.lit(1)
    return F.greatest(F.lit(stride), by_rate)


def duration_frames(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start + 1)


def duration_seconds(start: Column, end: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.round(duration_frames(start, end) / fps, 3)).otherwise(0.0)


def preview_frame(start: Column, end: Column, which: str = "mid") -> Column:
    if which not in ("start", "mid", "end"):
        raise ValueError(f"which is start, mid or end, not {which!r}")
    return {"start": start, "end": end, "mid": F.floor((start + end) / 2).cast("long")}[which]


def budget(ratio: float, n: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(F.ceil(n * ratio), F.lit(least)), F.lit(most))


def budget_penalty(chosen: Column, allowed: Column, penalty: float) -> Column:
    over, under = F.greatest(chosen - allowed, F.lit(0)), F.greatest(allowed - chosen, F.lit(0))
    return penalty * (over + 0.5 * under)


def probability(p: Column) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def target_segments(n: Column, max_len: int, kmin: int, kmax: int) -> Column:
    return clip(F.bround(n / max_len, 0).cast("int"), kmin, kmax) if max_len > 0 else F.lit(kmin)


def quality_from_distortion(score: Column) -> Column:
    return 1 / (1 + F.greatest(score, F.lit(0.0)))


def first_finite(*scores: Column) -> Column:
    finite = [F.when(~F.isnan(s) & (F.abs(s) != float("inf")), s) for s in scores]
    return F.coalesce(*finite)


def exposure(mean_luma: Column) -> Column:
    return 255 - 2 * F.abs(mean_luma - 128)


def heuristic_quality(sharpness: Column, mean_luma: Column) -> Column:
    return sharpness / (sharpness + 50) * F.exp(-((mean_luma - 128) ** 2) / (2 * 64.0**2))


def aspect_ratio(width: Column, height: Column, least: float = 1e-3) -> Column:
    return F.when((height > 0) & (width > 0), F.greatest(width / height, F.lit(least))).otherwise(1.0)


def foreground(x1: Column, y1: Column, x2: Column, y2: Column, area: Column, width: Column, height: Column) -> Column:
    """Box of a foreground with the y axis turned up; one of under a 200th of the image gives way to the middle 80 percent."""
    big = area > width * height / 200
    box = lambda own, share, size: F.when(big, own).otherwise((size * share).cast("int"))
    return F.struct(box(x1, 0.1, width).alias("x1"), box(x2, 0.9, width).alias("x2"), box(height - y2, 0.1, height).alias("y1"), box(height - y1, 0.9, height).alias("y2"))


def combined_objective(rec_error: Column, coverage: Column, *fallbacks: Column) -> Column:
    """0.7 (1 - reconstruction error) + 0.3 coverage; else the first fallback that is known, else 0."""
    both = 0.7 * (1 - known(rec_error)) + 0.3 * known(coverage)
    return F.coalesce(both, *[known(f) for f in fallbacks], F.lit(0.0))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def first_stem(path: Column) -> Column:
    """The name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


#: Extensions of images and of videos.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]
VIDEO_EXTENSIONS = [".mp4", ".mkv", ".avi", ".mov"]


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def scene_and_frame(name: Column) -> Column:
    """(scene, frame) of ``scene_<n>_frame_<n>``, else (0, the last number in the name), else (0, 0)."""
    both = r"scene_(\d+)_frame_(\d+)"
    numbers = F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))
    last = F.coalesce(F.try_element_at(numbers, F.lit(-1)).cast("long"), F.lit(0))
    named = name.rlike(both)
    return F.struct(
        F.when(named, F.regexp_extract(name, both, 1).cast("long")).otherwise(0).alias("scene"),
        F.when(named, F.regexp_extract(name, both, 2).cast("long")).otherwise(last).alias("frame"),
    )


def first_number(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("long"), F.lit(-1))


def image_name(scene: Column, frame: Column) -> Column:
    return F.format_string("scene_%04d_frame_%08d.jpg", scene, frame)


def flat_name(name: Column) -> Column:
    """A path as one name: slashes become underscores."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def without_prefix(name: Column, prefix: str = "module.") -> Column:
    """A name without ``prefix`` wherever it occurs."""
    return F.replace(name, F.lit(prefix), F.lit(""))


def iso_time(at: Column) -> Column:
    """A time as yyyy-mm-ddThh:mm:ss."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def key(name: Column) -> Column:
    return F.lower(F.trim(name))


#: Words that captions are searched for, and what stands in when there are none.
COLOURS = ["black", "blue", "brown", "gray", "green", "grey", "orange", "pink", "purple", "red", "white", "yellow"]
ANIMALS = ["bear", "bird", "cat", "dog", "duck", "fish", "horse", "mouse", "pig", "rabbit"]
GENERIC = ["character", "cartoon", "animal", "person", "boy", "girl", "man", "woman"]


def caption_phrases(caption: Column, colours: list[str] = COLOURS, animals: list[str] = ANIMALS, generic: list[str] = GENERIC, fallback: tuple[str, ...] = ("character", "cartoon"), most: int = 20) -> Column:
    """Colour-animal phrases, animals and generic words of a caption, distinct in this order, ``most`` at most; else ``fallback``."""
    low = F.lower(caption)
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)))
    strings = lambda values: F.array(*[F.lit(v) for v in values])
    c, a = F.array_intersect(strings(colours), tokens), F.array_intersect(strings(animals), tokens)
    pairs = F.flatten(F.transform(c, lambda x: F.transform(a, lambda y: F.concat(x, F.lit(" "), y))))
    words = F.filter(strings(generic), lambda g: low.contains(g))
    found = F.array_distinct(F.concat(pairs, a, words))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(strings(fallback)), 1, most)


def feature_hash(v: Column, ends: int = 10) -> Column:
    """16 hex digits for a vector: its length, and its first and last values."""
    head, tail = F.slice(v, 1, ends), F.slice(v, -F.least(F.size(v), F.lit(ends)), ends)
    return F.substring(F.md5(F.concat_ws(",", F.size(v).cast("string"), F.concat_ws(",", head.cast("array<string>")), F.concat_ws(",", tail.cast("array<string>")))), 1, 16)


def chunks(v: Column, size: int) -> Column:
    """An array cut into pieces of ``size``."""
    n = F.size(v)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(v, s, F.lit(size)))


def linspace_kept(pos: Column, n: Column, cap: int) -> Column:
    """Whether position ``pos`` of ``n`` is among ``cap`` evenly spread ones, ends included; all are where ``n <= cap``.

    The kept positions are floor(i (n - 1) / (cap - 1)) in doubles, the last one n - 1.
    """
    if cap <= 0:
        return F.lit(True)
    if cap == 1:
        return pos == 0
    step = (n - 1).cast("double") / (cap - 1)
    i = F.ceil(pos / step)
    at = lambda k: F.when(k >= cap - 1, n - 1).otherwise(F.floor(k * step))
    near = [at(i + d) == pos for d in (-1, 0, 1)]
    inside = [(i + d >= 0) & (i + d <= cap - 1) for d in (-1, 0, 1)]
    return (n <= cap) | (near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2])


def linspace_positions(n: Column, m: int | Column) -> Column:
    """Array of ``m`` positions in 0 to n - 1, evenly spread, ends included."""
    m = F.lit(m) if not isinstance(m, Column) else m
    step = (n - 1).cast("double") / (m - 1)
    at = lambda i: F.when((i == m - 1) & (m > 1), n - 1).when(m == 1, F.lit(0)).otherwise(F.floor(i * step)).cast("long")
    return F.when((m > 0) & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), at)).otherwise(F.array().cast("array<long>"))


def geomspace(low: float, high: float, n: int) -> Column:
    ratio = math.log(high / low) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low * F.exp(i * ratio))


def position_encoding(pos: Column, size: int) -> Column:
    """Sines at even places and cosines at odd ones, of wavelengths from 2 pi to 10000 * 2 pi."""
    rate = lambda i: F.exp(-(i - F.pmod(i, F.lit(2))) * math.log(10000.0) / size)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.pmod(i, F.lit(2)) == 0, F.sin(pos * rate(i))).otherwise(F.cos(pos * rate(i))))


def vector_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors."""
    c = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    return F.degrees(F.acos(clip(c, -1.0, 1.0)))


def set_only(options: Column) -> Column:
    """A map without its unset entries: nulls and empty strings."""
    return F.map_filter(options, lambda k, v: v.isNotNull() & (v != ""))


def rescaled(width: Column, height: Column, longest: int = 1024, shortest: int = 64) -> Column:
    """(width, height) with the longer side at most ``longest``, the shorter at least ``shortest``, in the same proportion."""
    factor = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.bround(width * factor, 0).cast("int"), F.lit(shortest)).alias("width"), F.greatest(F.bround(height * factor, 0).cast("int"), F.lit(shortest)).alias("height"))
