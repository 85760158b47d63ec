"""Reading videos' frames, scenes, keys and results; formats and columns are resolved when the plan is made."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import scalars
from reelspark.operators import batch

#: Names under which a key's frame may be stored, in order.
FRAME_COLUMNS = ["frame_idx", "frame_global", "frame"]
SCENES = "scene_id INT, start_frame BIGINT, end_frame BIGINT, start_time STRING, end_time STRING, duration_frames BIGINT, duration_seconds DOUBLE"


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of the files, without their content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(folder).select("path", "modificationTime", "length").distinct()


def videos(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Videos below a folder: mp4 in any case, or by a glob."""
    return files(spark, folder, pattern or "*.[mM][pP]4").withColumn("video_id", scalars.stem(F.col("path"))).orderBy("path")


def videos_in(spark: SparkSession, folder: str) -> DataFrame:
    """Videos of all known kinds right in a folder."""
    return files(spark, folder, "*.{mp4,mkv,avi,mov}", recursive=False).withColumn("video_id", scalars.stem(F.col("path"))).orderBy("path")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder with the scene and frame in their names, in that order."""
    found = files(spark, folder).where(scalars.is_image(F.col("path"))).withColumn("n", scalars.scene_and_frame(scalars.basename(F.col("path"))))
    return found.select("path", "n.scene", "n.frame").orderBy("scene", "frame", "path")


def probed(found: DataFrame, total: str = "total_frames", fps: str = "fps") -> DataFrame:
    """Missing frame counts 0, missing rates 30."""
    return found.withColumns({total: F.coalesce(total, F.lit(0)), fps: scalars.rate_or_default(F.col(fps))})


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes from JSON (a list of records), in order."""
    return spark.read.schema(SCENES).option("multiLine", "true").json(path).orderBy("start_frame")


def frame_column(df: DataFrame) -> Column:
    """The key's frame under the first of its known names; an error if none is there."""
    found = [c for c in FRAME_COLUMNS if c in df.columns]
    if not found:
        raise ValueError(f"none of {', '.join(FRAME_COLUMNS)} among {', '.join(df.columns)}")
    return F.coalesce(*[F.expr(f"try_cast(try_cast(nullif(trim(cast(`{c}` AS STRING)), '') AS DOUBLE) AS BIGINT)") for c in found])


def keyframes(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx) of a CSV of keys, ascending; blank cells go, repeats stay."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(frame_column(df).alias("frame_idx")).where("frame_idx IS NOT NULL").orderBy("frame_idx")


def keyframe_rows(spark: SparkSession, path: str, optional: tuple[str, ...] = ("selected",)) -> DataFrame:
    """All columns of a CSV of keys, with nulls for the optional ones that it lacks."""
    df = spark.read.option("header", "true").csv(path)
    return df.withColumn("frame_idx", frame_column(df)).withColumns({c: F.lit(None).cast("string") for c in optional if c not in df.columns})


def scene_features(spark: SparkSession, path: str) -> DataFrame:
    """Features partitioned by video and scene; flow and motion null where they weren't stored."""
    df = spark.read.parquet(path)
    extra = {c: F.lit(None).cast(t) for c, t in (("flow", "double"), ("motion", "array<float>")) if c not in df.columns}
    return df.withColumns(extra) if extra else df


def evaluation_results(spark: SparkSession, pattern: str, method: str | None = None) -> DataFrame:
    """(video_id, method, metric, value) of many nested JSON results; files that don't parse are skipped."""
    raw = spark.read.option("wholetext", "true").text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    nested = F.from_json("json", "map<string,string>", {"mode": "PERMISSIVE"})
    rows = raw.select(F.element_at(F.split("path", "/"), -2).alias("video_id"), F.explode(nested).alias("method", "metrics"))
    flat = rows.where(~F.col("metrics").startswith("{")).select("video_id", F.lit("method").alias("method"), F.col("method").alias("metric"), F.expr("try_cast(metrics AS DOUBLE)").alias("value"))
    deep = rows.where(F.col("metrics").startswith("{")).select("video_id", "method", F.explode(F.from_json("metrics", "map<string,string>")).alias("metric", "v")).select("video_id", "method", "metric", F.expr("try_cast(v AS DOUBLE)").alias("value"))
    out = flat.unionByName(deep)
    return out.where(F.col("method") == method) if method else out


def _document(spark: SparkSession, path: str) -> dict:
    """A small JSON file, such as a configuration: read whole on the driver."""
    return json.loads(spark.read.option("wholetext", "true").text(path).first()[0])


def grid(spark: SparkSession, path: str) -> DataFrame:
    """The settings of a JSON file of lists, one a parameter: every combination, as ``batch.grid`` numbers them. A lone value is a list of one."""
    return batch.grid(spark, {k: v if isinstance(v, list) else [v] for k, v in _document(spark, path).items()})


def summary(spark: SparkSession, path: str, method: str = "method") -> DataFrame:
    """(video_id, metric, value) of a batch summary: its results' metrics, those of ``method`` where they are by method."""
    results = F.from_json(F.get_json_object("value", "$.results"), "map<string,struct<metrics:string>>")
    rows = spark.read.option("wholetext", "true").text(path).select(F.explode(results).alias("video_id", "r"))
    chosen = F.coalesce(F.get_json_object("r.metrics", f"$.{method}"), F.col("r.metrics"))
    return rows.select("video_id", F.explode(F.from_json(chosen, "map<string,string>")).alias("metric", "v")).select("video_id", "metric", F.expr("try_cast(v AS DOUBLE)").alias("value"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at ``path``; made and written there if there is none yet, so embeddings are computed once."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def with_epoch(df: DataFrame, path: str = "path") -> DataFrame:
    """The epoch from ``ep<n>`` in the path."""
    return df.withColumn("epoch", F.nullif(F.regexp_extract(path, r"ep(\d+)", 1), F.lit("")).cast("int"))


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of metrics, each cell a number or null."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in df.columns])


def frames_at(frames: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The frames that are asked for; unknown ones are skipped."""
    return frames.join(ids.select(*on).distinct(), on, "left_semi")
