"""Streaming forms against their batch forms."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from reelspark.operators import signal
from reelspark.streaming import ordered, windows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def run(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()


def test_sessions(spark, tmp_path):
    run(windows.sessions(stream(spark), ["user_id"], "6 hours", "1 hour"), "sessions", tmp_path, "append")
    whole = windows.sessions(spark.read.parquet(f"{SF}/events.parquet"), ["user_id"], "6 hours", "1 hour")
    got, want = spark.table("sessions"), whole
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_pooled(spark, tmp_path):
    run(windows.pooled(stream(spark), ["event_type"], "1 hour", "1 hour", "value"), "pooled", tmp_path, "append")
    whole = windows.pooled(spark.read.parquet(f"{SF}/events.parquet"), ["event_type"], "1 hour", "1 hour", "value")
    keys = ["event_type", "start_ts"]
    assert spark.table("pooled").count() > 0 and spark.table("pooled").select(keys).exceptAll(whole.select(keys)).count() == 0


@pytest.fixture(scope="module")
def disorder(spark, tmp_path_factory):
    """(folder of five batches, the rows that count in order): out of order by up to 40 s; one row comes too late; a last batch moves the watermark on."""
    rng = random.Random(6)
    start = datetime.datetime(2024, 5, 1)
    rows = [(k, start + datetime.timedelta(seconds=10 * i + (i % 3 == 0)), i, rng.uniform(-5, 9)) for k, n in (("a", 120), ("b", 7), ("c", 11), ("d", 12)) for i in range(n)]
    rows += [("a", start + datetime.timedelta(seconds=100), 500 + i, float(i)) for i in range(3)]  # ties
    sent = sorted(rows, key=lambda r: (r[1] + datetime.timedelta(seconds=rng.uniform(0, 40)), r[2]))
    batches = [sent[i * len(sent) // 4 : (i + 1) * len(sent) // 4] for i in range(4)]
    batches[3].append(("a", start + datetime.timedelta(seconds=3), 900, 1000.0))
    batches.append([("end", start + datetime.timedelta(days=9), 1, 0.0)])
    folder = str(tmp_path_factory.mktemp("batches"))
    for b in batches:
        spark.createDataFrame(b, "k string, ts timestamp, id long, v double").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their times
    return folder, spark.createDataFrame(rows, "k string, ts timestamp, id long, v double")


def batches_of(spark, folder):
    return spark.readStream.schema("k string, ts timestamp, id long, v double").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("window", [11, 4, 3])
def test_centred(spark, disorder, tmp_path, window):
    folder, rows = disorder
    run(ordered.centred(batches_of(spark, folder), "k", "ts", "id", "v", "60 seconds", "1 day", window), f"centred{window}", tmp_path, "append")
    got = {(r["k"], r["id"]): r["score"] for r in spark.table(f"centred{window}").collect()}
    placed = rows.withColumn("at", F.struct("ts", "id"))
    want = {(r["k"], r["at"]["id"]): r["v"] for r in signal.local_zscore(placed, ["k"], "at", "v", window).collect()}
    assert got == pytest.approx(want)
    shown = spark.table(f"centred{window}").where("k = 'a'").collect()
    assert [r["ts"] for r in shown] == sorted(r["ts"] for r in shown)


def test_running(spark, disorder, tmp_path):
    folder, rows = disorder
    run(ordered.running(batches_of(spark, folder), "k", "ts", "id", "v", "60 seconds", "1 day"), "running", tmp_path, "append")
    got = {(r["k"], r["id"]): (r["n"], r["ema"], r["best"]) for r in spark.table("running").collect()}
    want, state = {}, {}
    for r in rows.orderBy("ts", "id").collect():
        n, ema, best = state.get(r["k"], (0, None, None))
        state[r["k"]] = want[r["k"], r["id"]] = (n + 1, r["v"] if n == 0 else 0.9 * ema + 0.1 * r["v"], r["v"] if n == 0 else max(best, r["v"]))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_silence_ends_a_sequence(spark, disorder, tmp_path):
    """Wherever two rows are further apart than the silence that ends a sequence, counting starts again."""
    folder, rows = disorder
    run(ordered.running(batches_of(spark, folder), "k", "ts", "id", "v", "60 seconds", "10 seconds"), "anew", tmp_path, "append")
    got = {(r["k"], r["id"]): r["n"] for r in spark.table("anew").collect()}
    want, last = {}, {}
    for r in rows.orderBy("ts", "id").collect():
        at, n = last.get(r["k"], (None, 0))
        n = 1 if at is None or (r["ts"] - at).total_seconds() > 10 else n + 1
        last[r["k"]] = (r["ts"], n)
        want[r["k"], r["id"]] = n
    assert got == want
    assert sorted(want.values())[-1] > 2
