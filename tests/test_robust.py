"""Pixels, files that can be taken up again, and code that fails."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import attempts, pixels
from reelspark.sources import keyed_files


def png(image):
    """A PNG file of (height, width, 1, 3 or 4) bytes, red first."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, c = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def plain_quality(image):
    """Sharpness, exposure and noise, pixel by pixel."""
    h, w, c = image.shape
    g = [[int(image[y, x, 0]) if c == 1 else (int(image[y, x, 0]) * 9798 + int(image[y, x, 1]) * 19235 + int(image[y, x, 2]) * 3735 + 16384) >> 15 for x in range(w)] for y in range(h)]
    mirror = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i if i >= n else i
    lap = [g[mirror(y - 1, h)][x] + g[mirror(y + 1, h)][x] + g[y][mirror(x - 1, w)] + g[y][mirror(x + 1, w)] - 4 * g[y][x] for y in range(h) for x in range(w)]
    mean = sum(lap) / len(lap)
    luma = sum(map(sum, g)) / (h * w)
    return sum((v - mean) ** 2 for v in lap) / len(lap), 255 - 2 * abs(luma - 128), sum(map(abs, lap)) / len(lap)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(3)
    path = tmp_path_factory.mktemp("images")
    images = {f"{i}.png": rng.integers(0, 256, shape, dtype=np.uint8) for i, shape in enumerate([(5, 7, 3), (1, 4, 1), (6, 1, 3), (1, 1, 3), (8, 8, 4), (9, 3, 1)])}
    for name, image in images.items():
        (path / name).write_bytes(png(image))
    (path / "broken.png").write_bytes(b"no image")
    return str(path), images


def test_quality_of_image_files(spark, folder):
    path, images = folder
    got = {os.path.basename(r["path"]): (r["sharpness"], r["exposure"], r["noise"]) for r in pixels.with_quality(pixels.images(spark, path)).collect()}
    assert set(got) == set(images)
    for name, image in images.items():
        assert got[name] == pytest.approx(plain_quality(image)), name
    med = pixels.technical_quality(pixels.images(spark, path).withColumn("g", F.lit(1)), ["g"]).first()
    assert med["noise_med"] == pytest.approx(np.median([plain_quality(i)[2] for i in images.values()]))


def test_conversions(spark, folder):
    path, images = folder
    rows = pixels.images(spark, path).select("path", pixels.rgb(F.col("image")).alias("rgb"), pixels.signed_planes(F.col("image")).alias("planes"), pixels.grey_values(F.col("image")).alias("grey"))
    for r in rows.collect():
        image = images[os.path.basename(r["path"])]
        three = np.repeat(image, 3, 2) if image.shape[2] == 1 else image[:, :, :3]
        assert r["rgb"] == three.ravel().tolist()
        assert r["planes"] == pytest.approx((three.transpose(2, 0, 1) / 127.5 - 1).ravel(), abs=1e-6)
        assert len(r["grey"]) == image.shape[0] * image.shape[1]


def test_images_without_pixels(spark):
    rows = spark.sql("SELECT 1 AS g, CAST(named_struct('height', 0, 'width', 3, 'nChannels', 3, 'data', X'') AS struct<height:int,width:int,nChannels:int,data:binary>) AS image UNION ALL SELECT 1, NULL UNION ALL SELECT 2, named_struct('height', 2, 'width', 2, 'nChannels', 1, 'data', X'00')")
    assert {tuple(r)[-3:] for r in pixels.with_quality(rows).collect()} == {(None, None, None)}
    assert pixels.technical_quality(rows, ["g"]).where("sharpness_med IS NULL").count() == 2
    assert rows.select(pixels.rgb(F.col("image")).alias("x")).where("x IS NULL").count() == 3
    assert pixels.with_quality(rows.where("false")).count() == 0


def files_of(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith(".") or f.endswith(".part"))


def test_a_write_that_was_stopped_goes_on(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.format_string("scene_%04d/frame_%08d.jpg", F.col("id") % 3, "id").alias("file"), F.concat(F.lit("pixels "), F.col("id")).alias("content"), "id").repartition(4)

    @F.udf("string")
    def poisoned(i, text):
        if i == 33:
            raise RuntimeError("killed here")
        return text

    with pytest.raises(Exception, match="killed here"):
        keyed_files.write(rows.withColumn("content", poisoned("id", "content")), path)
    assert keyed_files.done(spark, path) is None
    part = files_of(path) if os.path.isdir(path) else []
    assert not any(f.endswith(".part") for f in part)
    before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in part}
    left = keyed_files.missing(rows, path)
    assert left.count() == 40 - len(part)
    counts = keyed_files.write(rows, path)
    assert counts["written"] == 40 - len(part)
    assert counts["skipped"] == len(part)
    assert [f for f in files_of(path) if f != keyed_files.DONE] == sorted(r["file"] for r in rows.collect())
    assert all(os.stat(f"{path}/{f}").st_mtime_ns == t for f, t in before.items())
    assert keyed_files.write(rows, path) == {"written": 0, "skipped": 40, "size": 0}
    assert keyed_files.missing(rows, path).count() == 0
    forced = keyed_files.write(rows.withColumn("content", F.lit("new")), path, force=True)
    assert forced["written"] == 40
    assert open(f"{path}/{rows.first()['file']}").read() == "new"


def test_rows_of_one_name_and_without_content(spark, tmp_path):
    path = str(tmp_path / "odd")
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "file string, content string")
    assert keyed_files.write(rows, path)["written"] == 2
    assert open(f"{path}/b").read() == ""
    with pytest.raises(Exception, match="no file name"):
        keyed_files.write(spark.createDataFrame([(None, "x")], "file string, content string"), path)


def test_one_poisoned_video(spark):
    rows = spark.createDataFrame([(f"v{v}" if v else None, i, float(v * i)) for v in range(6) for i in range(4)], "video string, t int, x double")

    def measured(g):
        if (g["video"] == "v3").any():
            raise ValueError("cannot decode frame 7")
        return {"mean": g["x"].mean(), "n": len(g)}

    def perceptual(g):
        if (g["video"] == "v5").any():
            raise MemoryError
        return {"gap": g["x"].max(), "n": 99}

    done = attempts.attempted(rows, "video", {"evaluation": measured, "again": lambda g: {"least": g["x"].min()}}, {"perceptual": perceptual}).cache()
    got = {r["video"]: r for r in done.collect()}
    assert set(got) == {None, "v1", "v2", "v3", "v4", "v5"}
    assert (got["v3"]["metrics"], got["v3"]["error"], got["v3"]["stage"]) == (None, "ValueError: cannot decode frame 7", "evaluation")
    assert got["v2"]["metrics"] == {"mean": 3.0, "n": 99.0, "least": 0.0, "gap": 6.0}
    assert got["v5"]["metrics"] == {"mean": 7.5, "n": 4.0, "least": 0.0}
    assert got["v5"]["notes"] == {"perceptual": "MemoryError: "}
    assert sorted((r["video"], r["stage"]) for r in attempts.failures(done, "video").collect()) == [("v3", "evaluation"), ("v5", "perceptual")]


def test_fallback_chain(spark):
    rows = spark.range(20).repartition(1)

    def weak(g):
        if (g["id"] > 4).any():
            raise ImportError("no backend")
        return g

    got = attempts.first_that_works(rows, "id long", {"strong": weak, "plain": lambda g: g.assign(id=-g["id"])}).collect()
    assert {r["way"] for r in got} == {"plain"}
    assert sorted(-r["id"] for r in got) == list(range(20))
    with pytest.raises(Exception, match="no backend"):
        attempts.first_that_works(rows, "id long", {"strong": weak}).collect()
