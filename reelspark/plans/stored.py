"""Queries that write what they find in the library's formats, into the shared folder, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import vectors as V
from reelspark.functions.scalars import image_name
from reelspark.plans.catalog import _FRAMES, _SIGNAL, _r, query
from reelspark.plans.tables import frames, table
from reelspark.plans.tables import signal as signal_rows
from reelspark.sources import keyed_files, readers, writers
from reelspark.sources.shared import new_path

_KEYS = "k AS (SELECT user_id, event_type, t, value FROM s WHERE value > 40)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of high value as keys of a video (the user) and scene (their kind)."""
    return signal_rows(spark, sf_dir, "event_type").where("value > 40").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("scene_id"), F.col("t").alias("frame_idx"), F.col("value").alias("score"))


@query(f"WITH {_SIGNAL}, {_KEYS} SELECT user_id AS video_id, event_type AS scene_id, t AS frame_idx, round(value::DOUBLE, 6) AS score, NULL::VARCHAR AS selected FROM k")
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written as CSV and read with the columns that such files may lack."""
    writers.keyframes(_keys(spark, sf_dir), path := new_path(spark, "keys"))
    rows = readers.keyframe_rows(spark, path)
    return rows.select(F.col("video_id").cast("long").alias("video_id"), "scene_id", "frame_idx", F.col("score").cast("double").alias("score"), "selected")


@query(f"WITH {_SIGNAL}, {_KEYS} SELECT t AS frame_idx, count(*) AS n FROM k GROUP BY t")
def stored_key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all keys from their CSV, however often each stands there."""
    writers.keyframes(_keys(spark, sf_dir), path := new_path(spark, "keys"))
    return readers.keyframes(spark, path).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SIGNAL}, m AS (SELECT user_id, max(value) AS top FROM s GROUP BY user_id) SELECT s.user_id, t, round(value::DOUBLE, 6) AS value, (value = top)::INT AS selected FROM s JOIN m USING (user_id)")
def stored_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values with a mark on each user's highest, as CSV."""
    s = signal_rows(spark, sf_dir)
    top = s.groupBy("user_id").agg(F.max("value").alias("value"))
    writers.probabilities(s, top, ["user_id", "value"], path := new_path(spark, "probabilities"))
    rows = readers.metric_rows(spark, path)
    return rows.select(F.col("user_id").cast("long").alias("user_id"), F.col("t").cast("long").alias("t"), _r("value").alias("value"), F.col("selected").cast("int").alias("selected"))


@query(f"WITH {_FRAMES} SELECT label AS video_id, pos % 3 AS scene_id, count(*) AS n, round(sum(list_sum(v)), 4) AS total, 0::BIGINT AS with_flow FROM f GROUP BY ALL")
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in a folder for each video and scene; flow wasn't stored, so it is unknown."""
    f = frames(spark, sf_dir).select(F.col("label").alias("video_id"), (F.col("pos") % 3).alias("scene_id"), "pos", "embedding")
    writers.scene_features(f, path := new_path(spark, "features"))
    rows = readers.scene_features(spark, path)
    total = F.aggregate(V.doubles("embedding"), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy(F.col("video_id").cast("int").alias("video_id"), F.col("scene_id").cast("long").alias("scene_id")).agg(F.count(F.lit(1)).alias("n"), _r(F.sum(total), 4).alias("total"), F.count("flow").alias("with_flow"))


_MEASURED = f"{_SIGNAL}, e AS (SELECT user_id, event_type AS method, avg(value)::DOUBLE AS mean, count(*)::DOUBLE AS n FROM s GROUP BY ALL), r AS (SELECT user_id, method, metric, value FROM e UNPIVOT (value FOR metric IN (mean, n)))"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signal_rows(spark, sf_dir, "event_type").groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("video_id"), F.col("event_type").alias("method")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    return e.unpivot(["video_id", "method"], ["mean", "n"], "metric", "value")


@query(f"WITH {_MEASURED} SELECT 'u' || user_id AS video_id, method, metric, round(value, 6) AS value FROM r")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results nested by method, a JSON file for each video, by the sink that can be taken up again."""
    files = writers.nested_results(_measured(spark, sf_dir)).select(F.concat("video_id", F.lit("/eval_results.json")).alias("file"), F.col("json").alias("content"))
    keyed_files.write(files, path := new_path(spark, "results"))
    return readers.evaluation_results(spark, f"{path}/*/eval_results.json").withColumn("value", _r("value"))


@query(f"WITH {_MEASURED} SELECT method, metric, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY ALL")
def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall metrics, a folder of CSV for each method."""
    writers.metrics(_measured(spark, sf_dir), path := new_path(spark, "metrics"))
    rows = spark.read.option("header", "true").csv(path)
    return rows.groupBy("method", "metric").agg(F.count(F.lit(1)).alias("n"), _r(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query(f"WITH {_SIGNAL}, {_KEYS}, v AS (SELECT user_id, count(*) AS n FROM k GROUP BY user_id), o AS (SELECT user_id, n FROM v WHERE user_id % 3 <> 1) SELECT 'video_' || user_id AS video_id, n AS length, 2::BIGINT AS runs FROM o")
def stored_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each video, two thirds of them at first and all when the sink is taken up again; listed by their endings."""
    kind = F.when(F.col("video_id") % 3 == 1, "txt").when(F.col("video_id") % 3 == 2, "MP4").otherwise("mp4")
    files = _keys(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.concat(F.lit("video_"), "video_id", F.lit("."), kind).alias("file"), F.repeat(F.lit("x"), F.col("n")).alias("content"), "video_id")
    path = new_path(spark, "videos")
    first = keyed_files.write(files.where("video_id % 3 > 0"), path)
    again = keyed_files.write(files, path)
    runs = 2 if again["skipped"] == first["written"] else 0
    return readers.videos(spark, path).select("video_id", "length", F.lit(runs).cast("long").alias("runs"))


@query("SELECT DISTINCT n_nationkey::INT AS scene, c_custkey::INT AS frame FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0")
def stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images named by scene and frame, written and listed; files of other kinds don't count."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("frame"))
    files = c.select(image_name(F.col("scene"), F.col("frame")).alias("file"), F.lit("jpeg").alias("content"))
    keyed_files.write(files.unionByName(files.limit(1).withColumn("file", F.lit("notes.md"))), path := new_path(spark, "images"))
    return readers.images(spark, path).select(F.col("scene").cast("int").alias("scene"), F.col("frame").cast("int").alias("frame"))


@query(f"WITH {_SIGNAL} SELECT user_id, count(*) AS n, 1 AS made FROM s GROUP BY user_id")
def stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is made the first time it is asked for, and read the second time."""
    made: list[int] = []

    def make() -> DataFrame:
        made.append(1)
        return signal_rows(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    path = new_path(spark, "once")
    readers.cached(spark, path, make)
    return readers.cached(spark, path, make).withColumn("made", F.lit(len(made)))
