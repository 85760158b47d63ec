"""Measures and conversions of decoded images, as rows of Spark's image source or rasters of the same form.

An image is (height, width, nChannels, data): bytes row by row, channels blue, green, red (and alpha), or one of grey.
Each batch of images is one Arrow batch; an image is worked on as whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from reelspark.functions.scalars import exposure

#: Weights of blue, green and red in grey, in parts of 2 ** 15, rounded to the nearest.
GREY, GREY_BITS = (3735, 19235, 9798), 15
#: Fixed value: the number from whose mean brightness no one deducts.
MIDDLE = 128

_IMAGE = ("height", "width", "nChannels", "data")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image) of a folder of PNG, JPEG and like files; those that can't be decoded are left out."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select(F.col("image.origin").alias("path"), "image")


def raster(values: Column, height: int, width: int) -> Column:
    """A grey image from an array of ``height`` times ``width`` whole numbers, cut to 0 to 255."""
    byte = lambda v: F.lpad(F.hex(F.least(F.greatest(v.cast("long"), F.lit(0)), F.lit(255))), 2, "0")
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(F.transform(values, byte), "")).alias("data"))


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """(height, width, channels); nothing for an image without pixels or with too few bytes."""
    size = height * width * channels
    if size <= 0 or len(data) < size:
        return None
    return np.frombuffer(data, np.uint8, size).reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness 0 to 255 of each pixel; alpha plays no part."""
    if image.shape[2] < 3:
        return image[:, :, 0]
    weighted = sum(w * image[:, :, i].astype(np.int64) for i, w in enumerate(GREY))
    return ((weighted + (1 << (GREY_BITS - 1))) >> GREY_BITS).astype(np.uint8)


def laplacian(image: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel; beyond the border pixels are mirrored at the outermost one."""
    x = image.astype(float)
    rows = np.pad(x, ((1, 1), (0, 0)), "reflect" if x.shape[0] > 1 else "edge")
    columns = np.pad(x, ((0, 0), (1, 1)), "reflect" if x.shape[1] > 1 else "edge")
    return rows[:-2] + rows[2:] + columns[:, :-2] + columns[:, 2:] - 4 * x


def _each(image: pd.DataFrame) -> Iterator[np.ndarray | None]:
    for height, width, channels, data in zip(*(image[c] for c in _IMAGE), strict=True):
        yield None if pd.isna(height) or data is None else pixels(int(height), int(width), int(channels), data)


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("sharpness", "luma", "noise")]))
def _measures(image: pd.DataFrame) -> pd.DataFrame:
    out = []
    for p in _each(image):
        if p is None:
            out.append((None, None, None))
            continue
        g = grey(p)
        edges = laplacian(g)
        out.append((float(edges.var()), float(g.mean()), float(np.abs(edges).mean())))
    return pd.DataFrame(out, columns=["sharpness", "luma", "noise"], dtype=float)


def with_quality(rows: DataFrame, image: str = "image") -> DataFrame:
    """``rows`` with sharpness (variance of the Laplacian), exposure (255 less twice the distance of the mean
    brightness from the middle) and noise (mean size of the Laplacian); null for an image without pixels."""
    own = F.struct(*[F.col(f"{image}.{c}").alias(c) for c in _IMAGE])
    known = lambda c: F.when(~F.isnan(c), c)
    out = rows.withColumn("__m", _measures(own))
    return out.withColumns({"sharpness": known(F.col("__m.sharpness")), "exposure": known(exposure(F.col("__m.luma"))), "noise": known(F.col("__m.noise"))}).drop("__m")


def technical_quality(rows: DataFrame, keys: list[str], image: str = "image") -> DataFrame:
    """(keys, sharpness_med, exposure_med, noise_med): medians over each group's images; images without pixels don't count."""
    return with_quality(rows, image).groupBy(*keys).agg(*[F.median(c).alias(f"{c}_med") for c in ("sharpness", "exposure", "noise")])


def _converted(make):
    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(image: pd.DataFrame) -> pd.Series:
        return pd.Series([None if p is None else make(p).ravel().astype(np.float32) for p in _each(image)], dtype=object)

    return lambda image: run(F.struct(*[image[c].alias(c) for c in _IMAGE]))


def _rgb(p: np.ndarray) -> np.ndarray:
    return np.repeat(p[:, :, :1], 3, 2) if p.shape[2] < 3 else p[:, :, 2::-1]


def signed_planes(image: Column) -> Column:
    """Red, green and blue planes one after another, each value from -1 to 1; null for an image without pixels."""
    return _converted(lambda p: _rgb(p).transpose(2, 0, 1) / 255.0 * 2.0 - 1.0)(image)


def rgb(image: Column) -> Column:
    """Red, green and blue of each pixel, 0 to 255; grey counts as all three; null for an image without pixels."""
    return _converted(_rgb)(image)


def grey_values(image: Column) -> Column:
    """Brightness of each pixel, 0 to 255; null for an image without pixels."""
    return _converted(grey)(image)
