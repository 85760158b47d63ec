"""Mixing sources to target weights by the cube method.

Every source has a share of the mix; a document of a source is wanted ``target / source size``
times: the whole part for certain, the fraction by balanced sampling. The flight phase of the cube
method moves the fractions along directions in the null space of two constraints (documents and
words), so both totals stay as they are while one fraction after another becomes 0 or 1. Blocks of
a source fly on their own and leave at most two open fractions each; those fly again, block of
blocks. The last flight of a source joins what is left with one block held back, goes from large
documents to small ones, and passes what each landing misses on to the next smaller ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._store import bound_batches, id_key, id_value, materialize, text_hash, unused, with_names
from reelspark.llm._text import Words, blocks

#: Weights of the sources, by rank and repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: No source gives more than so many times its size.
MOST = 3.0
#: Documents that fly together; two at most stay open.
BLOCK_ROWS = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [Words(data, offsets).counts for _, _, data, offsets in blocks(batch)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "body", "source")), pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]), pa.int64())], ["key", "body", "source", "size"])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, body, source, size in words) of each row; a null text has size 0."""
    bound_batches(docs.sparkSession)
    rows = docs.select(id_key(docs[id_col]).alias("key"), text_hash(docs[text_col]).alias("body"), F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[source_col].cast("string").alias("source"))
    return rows.mapInArrow(_sizes, "key long, body long, source string, size long")


def targets(measured: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight of all sizes, none above ``most`` times its source.

    Sources in code-point order, null last, take the weights in turn. Filling to a common level does
    it in one step: with the sources in the order in which they reach their limit, the level is
    what is left for those that don't over their weights. The windows run over one row per source.
    """
    s = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.select("*", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))
    s = s.select("*", (F.col("source_size") * most).alias("limit"), (F.col("source_size") * most / F.col("weight")).alias("full_at"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(order), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    s = s.select("*", F.when(level < F.col("full_at"), level).alias("level"))
    # The first source that doesn't fill up sets the level for all that follow.
    s = s.select("*", F.min("level").over(every).alias("common"), F.min(F.when(F.col("level").isNotNull(), F.col("full_at"))).over(every).alias("from_at"))
    open_ = F.col("full_at") >= F.col("from_at")
    first = F.first("level", ignorenulls=True).over(Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("source", "source_size", F.when(F.coalesce(open_, F.lit(False)), F.least(F.col("limit"), first * F.col("weight"))).otherwise(F.col("limit")).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight phase: moves ``p`` until at most two stay between 0 and 1; sums of p and of p * size are kept.

    Three open units always have a direction that keeps both sums: the cross product of the two
    constraint rows. A draw decides between its ends so that expectations are kept too.
    """
    p = p.astype(float).copy()
    eps = 1e-9
    scale = max(float(size.max(initial=0)), 1.0)
    open_: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        sa, sb, sc = size[a] / scale, size[b] / scale, size[c] / scale
        direction = (sc - sb, sa - sc, sb - sa)
        if max(map(abs, direction)) < eps:
            direction = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(open_, direction, strict=True) if abs(d) >= eps)
        down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(open_, direction, strict=True) if abs(d) >= eps)
        step = up if draws[i] * (up + down) < down else -down
        for j, d in zip(open_, direction, strict=True):
            p[j] = min(1.0, max(0.0, p[j] + step * d))
        for j in open_:
            if not eps < p[j] < 1 - eps:
                p[j] = round(p[j])
        open_ = [j for j in open_ if eps < p[j] < 1 - eps]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing phase: of all ways to settle the few open units, the one nearest in words, then in documents."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    want_words, want_docs = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(float(size[j]) for k, j in enumerate(open_) if m >> k & 1) - want_words), abs(bin(m).count("1") - want_docs), m))
    p = p.copy()
    for k, j in enumerate(open_):
        p[j] = best >> k & 1
    return p


def settle(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight and landing from the largest documents to the smallest, in classes of like sizes.

    What the landing of a class misses in words is spread over the fractions of the next class, so
    in the end only the smallest documents' landing is left as an error.
    """
    p, order, missed = p.astype(float).copy(), np.argsort(-size, kind="stable"), 0.0
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and size[order[end]] * 1.5 >= size[order[start]]:
            end += 1
        own = order[start:end]
        wanted = float((p[own] * size[own]).sum()) + missed
        open_ = own[(p[own] > 1e-9) & (p[own] < 1 - 1e-9)]
        if missed and size[open_].sum():
            p[open_] = np.clip(p[open_] + missed / float(size[open_].sum()), 0.0, 1.0)
        p[own] = land(fly(p[own], size[own], draws[own]), size[own])
        missed = wanted - float((p[own] * size[own]).sum())
        start = end
    return p


def _flight(last: bool):
    def move(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "key", "body", "nth"], ignore_index=True)
        draws = (rows["draw"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        rows["p"] = (settle if last else fly)(rows["p"].to_numpy(), rows["size"].to_numpy(), draws)
        return rows

    return move


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: float, block_rows: int, seed: int) -> DataFrame:
    """(key, body, source, nth, size, source_size, target, copies): nth numbers rows that agree in the first three."""
    measured = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    goal = materialize(targets(measured, weights, most), "mix-targets")
    same = Window.partitionBy("key", "body", "source").orderBy(F.lit(0))
    rows = measured.alias("m").join(goal.alias("g"), F.col("m.source").eqNullSafe(F.col("g.source"))).select("m.key", "m.body", "m.source", "m.size", "g.source_size", "g.target")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.select("*", F.row_number().over(same).alias("nth"), ratio.alias("ratio"))
    rows = rows.select("*", F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"), F.xxhash64(F.lit(seed), "key", "body", "nth").alias("draw"))
    count = measured.count()
    schema = rows.schema.add("blk", "long").add("sid", "long")
    level = max(1, math.ceil(count / block_rows))
    sid = F.xxhash64(F.coalesce("source", F.lit("\0null")))
    rows = rows.select("*", F.pmod(F.xxhash64("draw", "key"), F.lit(level)).alias("blk"), sid.alias("sid"))
    reserve, rows = (rows.where("blk = 0"), rows.where("blk > 0")) if level > 1 else (rows, None)
    done = []
    while level > 1:
        flown = materialize(rows.groupBy("sid", "source", "blk").applyInPandas(_flight(False), schema), "mix-flight")
        done.append(flown.where((F.col("p") == 0) | (F.col("p") == 1)))
        level = math.ceil(level * 2 / block_rows)
        rows = flown.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("blk", F.pmod("blk", F.lit(level)))
    last = reserve if rows is None else reserve.unionByName(rows)
    done = reduce(DataFrame.unionByName, [*done, last.groupBy("sid", "source").applyInPandas(_flight(True), schema)])
    return done.withColumn("copies", (F.col("whole") + F.col("p")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    """One row per input row: id, source, size, source_size, target (its source's), copies, taken (copies * size).

    A null or empty text has size 0, and is drawn like the others: it counts among the documents. Null
    sources are one source, the last; null ids stay null; repeated rows are drawn each for itself.
    Sources of size 0 take nothing. Draws hash the row's id and text, so reruns agree; ties between
    draws are ordered by id and text. An empty table gives an empty table.
    """
    done = _drawn(docs, id_col, text_col, source_col, weights, most, block_rows, seed)
    return done.select(id_value("key").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    What ``mix`` says of nulls, empty texts and repeated rows holds. A row is known by its id, text
    and source, so rows that share an id are taken each as often as it was drawn; rows that agree in
    all three are told apart by a hash of all their columns.
    """
    drawn = _drawn(docs, id_col, text_col, source_col, weights, most, block_rows, seed).where("copies > 0")
    drawn = materialize(drawn.select("key", "body", "source", "nth", "copies"), "mix-copies").alias("d")
    named, key, body = with_names(docs, id_col, text_col)
    nth, copy = unused(named, "row_nth"), unused(named, "row_copy")
    source = named[source_col].cast("string")
    rows = named.select("*", F.row_number().over(Window.partitionBy(key, body, source).orderBy(F.xxhash64(*[named[c] for c in docs.columns]))).alias(nth))
    on = (rows[key] == F.col("d.key")) & (rows[body] == F.col("d.body")) & rows[source_col].cast("string").eqNullSafe(F.col("d.source")) & (rows[nth] == F.col("d.nth"))
    taken = rows.join(drawn, on).select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("d.copies"))).alias(copy))
    return taken.drop(copy)
