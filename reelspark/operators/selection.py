"""Choosing keyframes: medoids with suppression of neighbours, random picks, peaks, near-duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import vectors as V
from reelspark.operators import sampling
from reelspark.operators.distance import pairs, symmetric, vector_sums

_PICKS = "array<struct<score:double,pos:bigint>>"


def suppressed(candidates: Column, k: int | Column, radius: int) -> Column:
    """Greedy choice from an array of (score, pos) in order: at most ``k``, no two within ``radius`` positions."""
    start = F.array().cast(_PICKS)
    free = lambda acc, x: ~F.exists(acc, lambda y: F.abs(y["pos"] - x["pos"]) <= radius)
    return F.aggregate(candidates, start, lambda acc, x: F.when((F.size(acc) < k) & free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def _greedy(rows: DataFrame, keys: list[str], score: Column, pos: str, k: int, radius: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(score.cast("double").alias("score"), F.col(pos).cast("bigint").alias("pos"))))
    chosen = rows.groupBy(*keys).agg(ordered.alias("__c")).select(*keys, F.explode(suppressed(F.col("__c"), k, radius)).alias("p"))
    return chosen.select(*keys, F.col("p.pos").alias(pos), F.col("p.score").alias("score"))


def medoid_costs(rows: DataFrame, keys: list[str], pos: str, vector: str, name: str = "cosine") -> DataFrame:
    """Sum of each row's distances to the others of its group; 0 for a lone row.

    By cosine this needs no pairs: with S the sum of the group's n vectors, v's similarities to the
    others add up to v S - v v. Other measures form the pairs; thin the groups first.
    """
    if name == "cosine":
        v = V.doubles(vector)
        r = rows.select(*keys, pos, v.alias("__v")).join(vector_sums(rows, keys, vector), keys)
        return r.select(*keys, pos, ((F.col("n") - 1) - (V.dot(F.col("__v"), F.col("total")) - V.dot(F.col("__v"), F.col("__v")))).alias("cost"))
    d = symmetric(pairs(rows, keys, pos, name, vector), keys).groupBy(*keys, F.col("i").alias(pos)).agg(F.sum("d").alias("cost"))
    return rows.select(*keys, pos).join(d, [*keys, pos], "left").select(*keys, pos, F.coalesce("cost", F.lit(0.0)).alias("cost"))


def medoids(rows: DataFrame, keys: list[str], pos: str, vector: str, k: int = 1, radius: int = 0, name: str = "cosine", digits: int = 9) -> DataFrame:
    """(keys, pos, score): the ``k`` rows of least cost, none within ``radius`` positions of a better one; ties by position.

    Costs are compared after rounding to ``digits``, so the order of summation doesn't decide.
    """
    costs = medoid_costs(rows, keys, pos, vector, name).withColumn("cost", F.round("cost", digits))
    if k == 1:
        return sampling.top(costs, keys, [F.col("cost"), F.col(pos)], 1).withColumnRenamed("cost", "score")
    return _greedy(costs, keys, F.col("cost"), pos, k, radius)


def random_picks(rows: DataFrame, keys: list[str], pos: str, k: int, radius: int, seed: int) -> DataFrame:
    """As above, in the order of a hash instead of costs."""
    order = F.conv(F.substring(sampling.hashed(seed, *keys, pos), 1, 13), 16, 10).cast("long")  # 52 bits: whole in a double
    return _greedy(rows, keys, order, pos, k, radius).drop("score")


def peaks(rows: DataFrame, keys: list[str], pos: str, value: str, radius: int = 2, keep: int = 9999) -> DataFrame:
    """Largest values first, none within ``radius`` of a larger one; of equal values the later position wins."""
    r = rows.withColumn("__p", -F.col(pos))
    found = _greedy(r, keys, -F.col(value), "__p", keep, radius)
    return found.select(*keys, (-F.col("__p")).alias(pos), (-F.col("score")).alias(value))


def motion_peaks(rows: DataFrame, keys: list[str], pos: str, value: str, m: int) -> DataFrame:
    """The ``m`` rows that differ most from the row before."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(pos)))
    r = rows.select(*keys, pos, d.alias("d")).where("d IS NOT NULL")
    return sampling.top(r, keys, [F.col("d").desc(), F.col(pos)], m)


def without_similar(rows: DataFrame, keys: list[str], pos: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """Keys in order, each kept if its cosine with all kept before is under the threshold. Groups are keys of one video: small."""
    item = F.struct(F.col(pos).cast("bigint").alias("pos"), V.l2_normalize(V.doubles(vector)).alias("v"))
    start = F.array().cast("array<struct<pos:bigint,v:array<double>>>")
    like = lambda acc, x: F.exists(acc, lambda y: V.dot(y["v"], x["v"]) >= threshold)
    kept = F.aggregate("__c", start, lambda acc, x: F.when(like(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    r = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("__c"))
    return r.select(*keys, F.explode(kept).alias("k")).select(*keys, F.col("k.pos").alias(pos))
