"""Occurrences of seeds: which of them can matter, and where their surroundings are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._store import materialize
from reelspark.llm._text import signed

FOUND = "seed long, context long, key long, body long, pos int, last int"


def occurrences(seed: np.ndarray, context: np.ndarray, key: np.ndarray, body: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows of FOUND. Neighbouring anchors of a row with one seed and one context, as in a run of one
    character, are one occurrence from ``pos`` to ``last``."""
    new = np.ones(len(pos), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (context[1:] != context[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos))[: len(first)] - 1
    columns = [signed(seed[first]), signed(context[first]), key[first], body[first], pos[first].astype(np.int32), pos[last].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seed", "context", "key", "body", "pos", "last"])


def repeated(found: DataFrame, tag: str) -> DataFrame:
    """FOUND's rows whose seed occurs again, with: first (the smallest key of the context), twice (the
    context occurs more than once), multi (the seed has other contexts too).

    Seeds are counted by partial aggregation before any occurrence moves, so a seed that is in a third of
    all documents is one row a task there. Only occurrences of repeated seeds are kept, and the joins
    that bring the counts back to them are plain ones, whose large partitions Spark splits.
    """
    seeds = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"), F.max(F.col("last") > F.col("pos")).alias("loops"))
    seeds = seeds.where("n > 1 OR loops").select(F.col("seed").alias("s"), (F.col("low") != F.col("high")).alias("multi"))
    again = materialize(found.join(seeds, F.col("seed") == F.col("s")).drop("s"), f"{tag}-anchors")
    groups = again.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max(F.col("last") > F.col("pos")).alias("loops"))
    groups = groups.select(F.col("seed").alias("s"), F.col("context").alias("c"), "first", ((F.col("n") > 1) | F.col("loops")).alias("twice"))
    return materialize(again.join(groups, (F.col("seed") == F.col("s")) & (F.col("context") == F.col("c"))).where("twice OR multi").drop("s", "c"), f"{tag}-repeated")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("body"), pa.array([press(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["key", "body", "packed"])


def packed(rows: DataFrame) -> DataFrame:
    """(key, body, packed): the texts compressed, for exchanges that carry whole texts."""
    return rows.mapInArrow(_pack, "key long, body long, packed binary")


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
