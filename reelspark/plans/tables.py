"""The reference concepts on the given tables: frames, signals, videos, tall metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames: the label is the scene, pos the place in it."""
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", pos.cast("long").alias("pos"), "embedding")


def signal(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Events as a signal: the user is the sequence, t the place in it."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", t.cast("long").alias("t"), "value", *more)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as videos of as many frames as they have events, at 25 frames a second."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total_frames")).withColumn("fps", F.lit(25.0))
