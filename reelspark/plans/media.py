"""Queries on rasters made of vectors, and on groups whose code fails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import vectors as V
from reelspark.operators import attempts, pixels
from reelspark.plans.catalog import _SIGNAL, _r, query
from reelspark.plans.tables import signal, table

_SIDE = 8
_EDGE = "list_transform(range(0, 64), lambda i: p[(CASE WHEN i // 8 = 0 THEN 1 ELSE i // 8 - 1 END) * 8 + i % 8 + 1] + p[(CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END) * 8 + i % 8 + 1] + p[i - i % 8 + (CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END) + 1] + p[i - i % 8 + (CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END) + 1] - 4 * p[i + 1])"
_RASTER = f"x AS (SELECT vec_id, label, list_transform(embedding, lambda v: least(greatest(floor(v::DOUBLE * 256 + 128), 0), 255)::INT) AS p FROM embeddings), e AS (SELECT *, {_EDGE} AS d FROM x), q AS (SELECT vec_id, label, list_aggregate(d, 'var_pop') AS sharpness, 255 - 2 * abs(list_avg(p) - 128) AS exposure, list_avg(list_transform(d, lambda v: abs(v))) AS noise FROM e)"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda v: F.floor(v * 256 + 128)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", pixels.raster(F.transform(V.doubles("embedding"), level), _SIDE, _SIDE).alias("image"))


@query(f"WITH {_RASTER} SELECT vec_id, round(sharpness, 4) AS sharpness, round(exposure, 6) AS exposure, round(noise, 6) AS noise FROM q")
def raster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness, exposure and noise of every vector as an image of 8 by 8 pixels."""
    return pixels.with_quality(_rasters(spark, sf_dir)).select("vec_id", _r("sharpness", 4).alias("sharpness"), _r("exposure").alias("exposure"), _r("noise").alias("noise"))


@query(f"WITH {_RASTER} SELECT label, round(median(sharpness), 4) AS sharpness_med, round(median(exposure), 6) AS exposure_med, round(median(noise), 6) AS noise_med FROM q GROUP BY label")
def raster_quality_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    med = pixels.technical_quality(_rasters(spark, sf_dir), ["label"])
    return med.select("label", _r("sharpness_med", 4).alias("sharpness_med"), _r("exposure_med").alias("exposure_med"), _r("noise_med").alias("noise_med"))


def _measured(g: pd.DataFrame) -> dict[str, float]:
    if g["t"].max() % 7 == 3:
        raise ValueError(f"{int(g['t'].max())} frames can't be read")
    return {"mean": g["value"].mean(), "n": len(g)}


def _extra(g: pd.DataFrame) -> dict[str, float]:
    if len(g) % 5 == 0:
        raise LookupError("no weights")
    return {"gap": g["value"].max() - g["value"].min()}


@query(f"""WITH {_SIGNAL}, g AS (SELECT user_id, max(t) AS last, count(*) AS n, avg(value) AS mean, max(value) - min(value) AS gap FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN last % 7 <> 3 THEN round(mean, 6) END AS mean, CASE WHEN last % 7 <> 3 THEN n::DOUBLE END AS n, CASE WHEN last % 7 <> 3 AND n % 5 <> 0 THEN round(gap, 6) END AS gap,
CASE WHEN last % 7 = 3 THEN 'ValueError: ' || last || ' frames can''t be read' END AS error, CASE WHEN last % 7 = 3 THEN 'evaluation' END AS stage, CASE WHEN last % 7 <> 3 AND n % 5 = 0 THEN 'LookupError: no weights' END AS note FROM g""")
def attempted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events measured by code that fails for some: errors are rows, extras are merged where they came through."""
    done = attempts.attempted(signal(spark, sf_dir), "user_id", {"evaluation": _measured}, {"perceptual": _extra})
    return done.select("user_id", _r(F.col("metrics")["mean"]).alias("mean"), F.col("metrics")["n"].alias("n"), _r(F.col("metrics")["gap"]).alias("gap"), "error", "stage", F.col("notes")["perceptual"].alias("note"))
