"""How well keys stand for all frames: errors, coverage, diversity, quality, and comparisons of judgements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import vectors as V
from reelspark.functions.scalars import known
from reelspark.operators import sampling, scenes
from reelspark.operators.distance import MEASURES, closest, nearest_key, pairs, vector_sums


def nearest_key_metrics(frames: DataFrame, keyframes: DataFrame, keys: list[str], order: str, vector: str, tau: float = 0.3, also: tuple[str, ...] = ()) -> DataFrame:
    """RecErr (mean of 1 - best cosine) and TemporalCoverage (share of frames within ``tau``) by one join; null without keys."""
    n = nearest_key(frames, keyframes, keys, order, vector, also=also)
    d = 1 - F.col("similarity")
    return n.groupBy(*keys, *also).agg(F.avg(d).alias("rec_error"), F.avg((d <= tau).cast("double")).alias("temporal_coverage"))


def scene_coverage(scene_rows: DataFrame, keyframes: DataFrame, by: list[str]) -> DataFrame:
    """Share of scenes that hold a key."""
    return scenes.covered(scene_rows, keyframes, by).groupBy(*by).agg(F.avg(F.col("covered").cast("double")).alias("scene_coverage"))


def redundancy(keyframes: DataFrame, keys: list[str], pos: str, vector: str) -> DataFrame:
    """Mean cosine of pairs of keys, their least distance and their mean distance; no row below two keys.

    The means come from sums of vectors. Only the least distance takes all pairs, block by block.
    """
    near = closest(keyframes, keys, pos, vector).withColumnRenamed("d", "min_distance")
    return diversity(keyframes, keys, vector).join(near, keys).select(*keys, "redundancy", "min_distance", "diversity")


def diversity(keyframes: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, diversity, redundancy): mean of 1 - cosine and mean cosine of pairs of keys, from sums of vectors; 0 and null below two keys."""
    s = vector_sums(keyframes, keys, vector)
    mean = (V.dot(F.col("total"), F.col("total")) - F.col("squares")) / (F.col("n") * (F.col("n") - 1))
    return s.select(*keys, F.when(F.col("n") > 1, 1 - mean).otherwise(0.0).alias("diversity"), F.when(F.col("n") > 1, mean).alias("redundancy"))


def perceptual_gap(frames: DataFrame, keyframes: DataFrame, keys: list[str], order: str, vector: str, measure: str = "l2", key_order: str = "key_idx") -> DataFrame:
    """(keys, gap): mean over the frames of the least distance to a key, by any measure; null without keys."""
    k = keyframes.select(*keys, key_order, V.doubles(vector).alias("__k"))
    d = frames.select(*keys, order, V.doubles(vector).alias("__f")).join(k, keys, "left").select(*keys, order, MEASURES[measure](F.col("__f"), F.col("__k")).alias("d"))
    return d.groupBy(*keys, order).agg(F.min("d").alias("d")).groupBy(*keys).agg(F.avg("d").alias("gap"))


def perceptual_diversity(keyframes: DataFrame, keys: list[str], order: str, vector: str, measure: str = "l2", most: int = 2000, seed: int = 123) -> DataFrame:
    """(keys, diversity): mean distance of pairs of keys by any measure, 0 below two keys; over ``most`` pairs by the order of a hash where there are more."""
    p = sampling.hashed_sample(pairs(keyframes, keys, order, measure, vector), keys, ["i", "j"], most, seed)
    mean = p.groupBy(*keys).agg(F.avg("d").alias("__d"))
    return keyframes.select(*keys).distinct().join(mean, keys, "left").select(*keys, F.coalesce("__d", F.lit(0.0)).alias("diversity"))


def mean_motion(frames: DataFrame, keyframes: DataFrame, keys: list[str], order: str, motion: str) -> DataFrame:
    """(keys, mean_motion) of the chosen frames; groups without a chosen frame are absent."""
    chosen = keyframes.select(*keys, order).distinct()
    return frames.join(chosen, [*keys, order], "left_semi").groupBy(*keys).agg(F.avg(known(F.col(motion).cast("double"))).alias("mean_motion"))


def snapped_keys(keyframes: DataFrame, sampled: DataFrame, keys: list[str], frame: str = "frame_idx") -> DataFrame:
    """Distinct keys that are sampled frames; in groups without any, each key's nearest sampled frame, the earlier on ties.

    The nearest frames on both sides come from one window over keys and frames together.
    """
    k = keyframes.select(*keys, frame).distinct()
    both = k.join(sampled.select(*keys, frame).distinct(), [*keys, frame], "left_semi")
    rest = k.join(both.select(*keys).distinct(), keys, "left_anti")
    rows = rest.select(*keys, frame, F.lit(1).alias("__k")).unionByName(sampled.select(*keys, frame, F.lit(0).alias("__k")).distinct())
    at = F.when(F.col("__k") == 0, F.col(frame))
    by = Window.partitionBy(*keys).orderBy(frame, "__k")
    before = F.last(at, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.col(frame).desc(), F.col("__k").desc())
    after = F.last(at, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near = F.when(after.isNull() | (F.col(frame) - before <= after - F.col(frame)), before).otherwise(after)
    found = rows.select(*keys, "__k", near.alias(frame)).where(F.col("__k") == 1).where(F.col(frame).isNotNull()).select(*keys, frame).distinct()
    return both.unionByName(found)


def technical_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of sharpness, exposure and noise."""
    return rows.groupBy(*keys).agg(*[F.median(known(F.col(c))).alias(f"{c}_med") for c in ("sharpness", "exposure", "noise")])


def frechet(a: np.ndarray, b: np.ndarray, eps: float = 1e-6) -> float:
    """Distance of two samples by means and covariances, with the root of the symmetrised product; NaN below two rows."""
    if len(a) < 2 or len(b) < 2:
        return float("nan")
    (m1, s1), (m2, s2) = ((x.mean(0), np.atleast_2d(np.cov(x, rowvar=False)) + eps * np.eye(x.shape[1])) for x in (a, b))
    product = s1 @ s2
    values = np.linalg.eigvalsh((product + product.T) / 2)
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(values, 0)).sum())


def moments(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Count, sums and sums of products of vectors, added up on the executors: groups of any size."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, g in batch.groupby(keys, dropna=False):
                x = np.stack(g[vector].to_numpy()).astype(float)
                out.append((*k, len(x), x.sum(0), (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "n", "s", "ss"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields), "n long, s array<double>, ss array<double>"])
    parts = rows.select(*keys, vector).mapInPandas(add, schema)

    def merge(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*k, int(g["n"].sum()), np.sum(g["s"].tolist(), axis=0), np.sum(g["ss"].tolist(), axis=0))], columns=[*keys, "n", "s", "ss"])

    return parts.groupBy(*keys).applyInPandas(merge, schema)


def frechet_distance(frames: DataFrame, keyframes: DataFrame, keys: list[str], vector: str, eps: float = 1e-6) -> DataFrame:
    """(keys, frechet) of all frames against the keys, from moments; null below two rows on a side."""
    a, b = moments(frames, keys, vector), moments(keyframes, keys, vector)
    joined = a.join(b.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("n", "s", "ss")]), keys)

    def law(n: int, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / n
        return mean, (ss.reshape(len(s), len(s)) - n * np.outer(mean, mean)) / (n - 1) + eps * np.eye(len(s))

    def distance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.n < 2 or row.n2 < 2:
                    out.append(None)
                    continue
                (m1, s1), (m2, s2) = law(row.n, np.asarray(row.s), np.asarray(row.ss)), law(row.n2, np.asarray(row.s2), np.asarray(row.ss2))
                product = s1 @ s2
                values = np.linalg.eigvalsh((product + product.T) / 2)
                out.append(float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(values, 0)).sum()))
            yield batch[keys].assign(frechet=pd.array(out, "Float64"))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys).schema.fields), "frechet double"])
    return joined.mapInPandas(distance, schema)


def directions(size: int, n: int, seed: int = 42) -> list[list[float]]:
    v = np.random.default_rng(seed).normal(size=(n, size))
    return (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)).tolist()


def sliced_wasserstein(frames: DataFrame, keyframes: DataFrame, keys: list[str], ident: str, vector: str, size: int, n_directions: int = 16, most: int = 200_000, seed: int = 42) -> DataFrame:
    """(keys, swd): mean over fixed random directions of the 1-D Wasserstein distance of two samples.

    Both sides are cut to the same size by the order of a hash; ranks of the projections are then
    joined, so no group is held in one place beyond its window.
    """
    from reelspark.functions.vectors import dot, doubles

    dirs = F.array(*[F.struct(F.lit(i).alias("d"), F.array(*[F.lit(x) for x in v]).alias("v")) for i, v in enumerate(directions(size, n_directions, seed))])
    hashed = Window.partitionBy(*keys).orderBy(sampling.hashed(seed, ident), ident)
    sides = [s.select(*keys, ident, doubles(vector).alias("x"), F.row_number().over(hashed).alias("r"), F.lit(i).alias("side")) for i, s in enumerate((frames, keyframes))]
    counts = [s.groupBy(*keys).agg(F.max("r").alias(f"n{i}")) for i, s in enumerate(sides)]
    size_ = counts[0].join(counts[1], keys).select(*keys, F.least("n0", "n1", F.lit(most)).alias("n"))
    rows = sides[0].unionByName(sides[1]).join(size_, keys).where("r <= n")
    proj = rows.select(*keys, "side", ident, F.explode(dirs).alias("d"), "x").select(*keys, "side", ident, F.col("d.d").alias("d"), dot(F.col("x"), F.col("d.v")).alias("p"))
    rank = F.row_number().over(Window.partitionBy(*keys, "d", "side").orderBy("p", ident))
    proj = proj.select(*keys, "d", "side", "p", rank.alias("rank"))
    gap = F.abs(F.max(F.when(F.col("side") == 0, F.col("p"))) - F.max(F.when(F.col("side") == 1, F.col("p"))))
    return proj.groupBy(*keys, "d", "rank").agg(gap.alias("__gap")).groupBy(*keys, "d").agg(F.avg("__gap").alias("w")).groupBy(*keys).agg(F.avg("w").alias("swd"))


def multi_scale_wasserstein(frames: DataFrame, keyframes: DataFrame, keys: list[str], ident: str, vector: str, size: int, scales: int = 3, n_directions: int = 16, most: int = 200_000, seed: int = 42) -> DataFrame:
    """(keys, swd): mean of the sliced distance over scales; scale s has every 2**s-th point of each side in the order of ``ident``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ident)) - 1
    at = F.filter(F.sequence(F.lit(0), F.lit(scales - 1)), lambda s: F.pmod("__place", F.pow(F.lit(2), s).cast("int")) == 0)
    sides = [s.withColumn("__place", place).select("*", F.explode(at).alias("__scale")) for s in (frames, keyframes)]
    each = sliced_wasserstein(*sides, [*keys, "__scale"], ident, vector, size, n_directions, most, seed)
    return each.groupBy(*keys).agg(F.avg("swd").alias("swd"))


def reward(weights: dict[str, float], diversity: Column, rec_error: Column, frechet_: Column, swd: Column, motion: Column, chosen: Column) -> Column:
    """Weighted sum of diversity, 1 - error, motion less error, Fréchet and Wasserstein terms; 0 for an empty choice."""
    w = lambda k: F.lit(float(weights.get(k, 0.0)))
    z = lambda x: F.coalesce(known(x), F.lit(0.0))
    value = w("div") * z(diversity) + w("rep") * (1 - z(rec_error)) - w("rec") * z(rec_error) - w("fd") * z(frechet_) - w("ms") * z(swd) + w("motion") * z(motion)
    return F.when(F.coalesce(chosen, F.lit(0)) > 0, value).otherwise(0.0)


def two_afc(rows: DataFrame, keys: list[str], d0: str = "d0", d1: str = "d1", judge: str = "judge") -> DataFrame:
    """Agreement of the smaller distance with the share of judges for the second."""
    a, b, g = F.col(d0), F.col(d1), F.col(judge)
    return rows.groupBy(*keys).agg(F.avg(F.when(a < b, 1 - g).when(b < a, g).otherwise(0.5)).alias("two_afc"))


def average_precision(rows: DataFrame, keys: list[str], d: str, same: str, tie: str) -> DataFrame:
    """Area under the precision envelope of "same" judgements in the order of their distance.

    The envelope is a running maximum from the far end: a frame that reaches to the end would go over all following rows for each.
    """
    by = Window.partitionBy(*keys).orderBy(d, tie)
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    tp, n, every = F.sum(same).over(run), F.count(F.lit(1)).over(run), F.sum(same).over(Window.partitionBy(*keys))
    r = rows.select(*keys, n.alias("n"), (tp / n).alias("precision"), (tp / every).alias("recall"))
    by = Window.partitionBy(*keys)
    envelope = F.max("precision").over(by.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(by.orderBy("n")), F.lit(0.0))
    r = r.select(*keys, (step * envelope).alias("area"))
    return r.groupBy(*keys).agg(F.sum("area").alias("average_precision"))


def nearest_per_key(assigned: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` frames nearest to each key."""
    return sampling.top(assigned, [*keys, "key_idx"], [F.col("similarity").desc(), F.col(order)], n)
