"""Writing scenes, keys, metrics and layouts; writers are Spark's, so parts are written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import scalars


def as_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; rows in the order of the frame's sort."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def scenes(df: DataFrame, path: str) -> None:
    """Scenes in both formats."""
    rows = df.orderBy(*[c for c in ("video_id", "scene_id") if c in df.columns])
    as_json(rows, f"{path}/scenes.json")
    as_csv(rows, f"{path}/scenes.csv")


def keyframes(df: DataFrame, path: str) -> None:
    """Keys by scene and frame, scores to 6 digits."""
    rows = df.withColumn("score", F.round("score", 6)) if "score" in df.columns else df
    as_csv(rows.orderBy(*[c for c in ("video_id", "scene_id", "frame_idx") if c in df.columns]), path)


def probabilities(df: DataFrame, chosen: DataFrame, on: list[str], path: str) -> None:
    """All probabilities with ``selected`` 0 or 1."""
    mark = chosen.select(*on).distinct().withColumn("selected", F.lit(1))
    as_csv(df.join(mark, on, "left").withColumn("selected", F.coalesce("selected", F.lit(0))), path)


def metrics(df: DataFrame, path: str) -> None:
    """Tall metrics, a folder for each method."""
    df.write.mode("overwrite").partitionBy("method").option("header", "true").csv(path)


def scene_features(df: DataFrame, path: str) -> None:
    """Features by video and scene, so that a reader of one scene opens its folder alone."""
    df.repartition("video_id", "scene_id").write.mode("overwrite").partitionBy("video_id", "scene_id").parquet(path)


def named_images(keys: DataFrame) -> DataFrame:
    return keys.withColumn("file", scalars.image_name(F.col("scene_id"), F.col("frame_idx")))


def nested_results(rows: DataFrame) -> DataFrame:
    """(video_id, json): method to metric to value."""
    entries = F.sort_array(F.collect_list(F.struct("method", "metric", "value")))
    methods = F.array_distinct(F.transform("e", lambda x: x["method"]))
    of = lambda m: F.map_from_entries(F.transform(F.filter("e", lambda x: x["method"] == m), lambda x: F.struct(x["metric"], x["value"])))
    return rows.groupBy("video_id").agg(entries.alias("e")).select("video_id", F.to_json(F.map_from_arrays(methods, F.transform(methods, of))).alias("json"))


def layout_json(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, json): parts of each layout in order."""
    fields = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order])))).alias("json"))
