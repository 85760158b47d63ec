"""Results of many sequences, methods and parameter settings, in tall form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions.scalars import combined_objective, known, or_zero

#: Metrics of which less is better when methods are compared; of all others more is.
LESS_IS_BETTER = ["RecErr", "Frechet", "Noise_med", "RedundancyMeanCos", "MinPairwiseDist"]
#: The metrics of a batch summary.
SUMMARIZED = ["RecErr", "Frechet", "SceneCoverage", "TemporalCoverage@tau", "LPIPS_PerceptualGap", "LPIPS_DiversitySel", "MS_SWD_Color"]
#: Weights of the scorecard, by family of metrics.
SCORECARD = {"representativeness": 0.3, "coverage": 0.3, "diversity": 0.2, "quality": 0.2}


def tall(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value)."""
    return wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def metric_summary(rows: DataFrame, by: list[str], value: str = "value", skip_nan: bool = True) -> DataFrame:
    """Mean, population deviation, least, most and count of each metric; null where nothing is known."""
    v = known(F.col(value)) if skip_nan else F.col(value)
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def column_means(wide: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    return wide.groupBy(*(by or [])).agg(*[F.avg(known(F.col(m).cast("double"))).alias(m) for m in metrics])


def outcome_counts(rows: DataFrame, error: str) -> DataFrame:
    """Successes and failures, by whether an error is there."""
    return rows.agg(F.count_if(F.col(error).isNull()).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"))


def merged_metrics(base: DataFrame, extra: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Full outer merge; the extra value wins."""
    b, e = base.withColumnRenamed(value, "__b"), extra.withColumnRenamed(value, "__e")
    return b.join(e, on, "full_outer").select(*on, F.coalesce("__e", "__b").alias(value))


def summed(parts: list[DataFrame], by: list[str], n: str = "n") -> DataFrame:
    """Sum of several histograms."""
    return reduce(DataFrame.unionByName, [p.select(*by, n) for p in parts]).groupBy(*by).agg(F.sum(n).alias(n))


def wins(rows: DataFrame, video: str = "video_id", method: str = "method", less: list[str] | None = None) -> DataFrame:
    """How often each method is the best of a video's metric; ties go to the first name."""
    signed = F.when(F.col("metric").isin(less if less is not None else LESS_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    best = Window.partitionBy(video, "metric").orderBy("__s", method)
    r = rows.where(known(F.col("value")).isNotNull()).withColumn("__s", signed).withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return r.groupBy(method).agg(F.count(F.lit(1)).alias("n_best"))


def best_step(rows: DataFrame, by: list[str], step: str, less: list[str] | None = None) -> DataFrame:
    """The step at which each metric is best; the first of equals."""
    signed = F.when(F.col("metric").isin(less if less is not None else LESS_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    r = rows.where(known(F.col("value")).isNotNull())
    return r.groupBy(*by, "metric").agg(F.min_by(F.struct(step, "value"), F.struct(signed.alias("s"), F.col(step).alias("t"))).alias("b")).select(*by, "metric", f"b.{step}", "b.value")


def in_all(rows: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    n = rows.agg(F.count_distinct(group).alias("n"))
    return rows.groupBy(item).agg(F.count_distinct(group).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(item)  # a single row


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """(iter, one column a parameter): every combination, numbered in the order of the lists."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("iter"))
    for name, values in parameters.items():
        each = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("__p", name)
        out = out.select("*", each).withColumn("iter", F.col("iter") * len(values) + F.col("__p")).drop("__p")
    return out


def grid_scores(results: DataFrame, by: list[str], rec_error: str, coverage: str) -> DataFrame:
    """Mean objective of each setting over the sequences that have one; 0 if none."""
    return results.groupBy(*by).agg(F.coalesce(F.avg(combined_objective(F.col(rec_error), F.col(coverage))), F.lit(0.0)).alias("score"))


def best_setting(scores: DataFrame, order: str = "iter") -> DataFrame:
    """The first setting of the highest score."""
    return scores.orderBy(F.col("score").desc(), order).limit(1)


def summary_table(rows: DataFrame, video: str, metrics: list[str], most: int = 50) -> DataFrame:
    """A wide table of the first ``most`` videos, unknown values 0."""
    first = rows.select(video).distinct().orderBy(video).limit(most)
    wide = rows.join(first, video, "left_semi").groupBy(video).pivot("metric", metrics).agg(F.first("value"))
    return wide.select(video, *[or_zero(F.col(m)).alias(m) for m in metrics])


def epoch_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of training steps (reward, selected, frames, entropy, prob): means, selection ratio, spread."""
    return rows.groupBy(*by).agg(
        F.avg("reward").alias("mean_reward"),
        (F.sum("selected") / F.sum("frames")).alias("selection_ratio"),
        F.avg("entropy").alias("mean_entropy"),
        F.avg("prob").alias("mean_prob"),
        F.stddev_pop("reward").alias("std_reward"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
        *([F.avg(F.abs(F.col("selected") - F.col("budget"))).alias("mean_budget_gap")] if "budget" in rows.columns else []),
    )


def histogram(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n): counts of a value in ``bins`` equal parts of low to high; the last part has its upper end, and what lies outside is left out."""
    x = known(F.col(value).cast("double"))
    at = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    return rows.where((x >= low) & (x <= high)).groupBy(*by, at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def checked(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``rows`` with ``error``: the name of the first condition that isn't met, null if all are. A video that fails is a row, not the end of the batch."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]
    return rows.withColumn("error", F.coalesce(*failed))


def summary_document(rows: DataFrame, video: str, metrics: list[str] | None = None, error: str = "error") -> DataFrame:
    """One row: counts of videos that were processed and that failed, the mean of each metric over the former, and all as JSON."""
    metrics = metrics or SUMMARIZED
    ok = F.col(error).isNull()
    means = F.struct(*[F.avg(F.when(ok, known(F.col(m).cast("double")))).alias(f"{m}_mean") for m in metrics])
    out = rows.agg(F.count_distinct(F.when(ok, F.col(video))).alias("total_processed"), F.count_distinct(F.when(~ok, F.col(video))).alias("total_failed"), means.alias("aggregate_metrics"))
    return out.withColumn("json", F.to_json(F.struct(F.struct("total_processed", "total_failed").alias("statistics"), "aggregate_metrics")))


def total_detections(rows: DataFrame, by: list[str], boxes: str) -> DataFrame:
    """(by, n_boxes): how many boxes the frames have; a frame without a list has none."""
    return rows.groupBy(*by).agg(F.sum(F.coalesce(F.size(F.when(F.col(boxes).isNotNull(), F.col(boxes))), F.lit(0))).alias("n_boxes"))


def hit_rate(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """(by, hits, misses, rate) of lookups."""
    h, n = F.count_if(hit), F.count(F.lit(1))
    return rows.groupBy(*by).agg(h.alias("hits"), (n - h).alias("misses"), (h / n).alias("rate"))


def selection_statistics(keys: DataFrame, by: list[str], frame: str, prob: str) -> DataFrame:
    """Of chosen frames: count, mean probability, mean distance to the next, range."""
    gap = F.col(frame) - F.lag(frame).over(Window.partitionBy(*by).orderBy(frame))
    return keys.withColumn("__g", gap).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg("__g").alias("mean_spacing"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))


def scorecard(wide: DataFrame, families: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of families of metrics, each cut to 0 to 1; unknown ones count as 0."""
    weights = weights or SCORECARD
    part = lambda name: F.least(F.greatest(or_zero(families[name]), F.lit(0.0)), F.lit(1.0)) * weights[name]
    return reduce(lambda a, b: a + b, [part(n) for n in weights if n in families])


def latest(rows: DataFrame, by: list[str], path: str, time: str) -> DataFrame:
    """The most recent path of each group."""
    return rows.groupBy(*by).agg(F.max_by(path, F.struct(time, path)).alias(path))


def first_existing(candidates: DataFrame, existing: DataFrame, by: list[str], path: str, priority: str) -> DataFrame:
    """The candidate of best priority that exists."""
    return candidates.join(existing.select(path).distinct(), path, "left_semi").groupBy(*by).agg(F.min_by(path, priority).alias(path))


def missing(wanted: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is still to do: rows whose key isn't done."""
    return wanted.join(done.select(*on).distinct(), on, "left_anti")
