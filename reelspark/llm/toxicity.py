"""Toxicity by maximum-scoring segments.

Tokens (runs of letters, A-Z in lower case) are hashed to a fixed number of buckets. A bucket's
score is its log-odds in toxic against other labelled documents, with an informative Dirichlet
prior from the counts of the whole corpus, shrunk by its z-score, less a drift that makes ordinary
text lose. In each document a linear-time scan finds all maximal-scoring segments. Segment scores
follow an extreme-value law whose scale comes from the corpus's bucket frequencies and whose
location from labelled clean documents; the evidence of the significant segments is turned into
a probability by a logistic fit on the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._store import id_key, id_value, materialize, texts, without
from reelspark.llm._text import NOT_LETTER, Bytes, Words, blocks, lower

#: Buckets of tokens: bounds what is counted and broadcast.
BUCKETS = 1 << 18
#: Labelled rows that the fit takes at most, by the order of a hash of their id.
TRAIN_ROWS = 100_000
#: Tokens of prior that the corpus stands for in each class, as a share of the labelled tokens.
PRIOR = 0.05
DRIFT = 0.5
#: Log-odds and z-scores: the z-score at which half of the log-odds counts.
HALF_Z = 4.0
#: Expected chance segments in a document, below which a segment is significant.
E_VALUE = 0.01


def _bucketed(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(data, offsets, NOT_LETTER)
    hashes = Bytes(lower(data)).slices(words.starts, words.ends)
    return words, (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((3, BUCKETS), np.int64)
    for batch in batches:
        toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in blocks(batch):
            words, bucket = _bucketed(data, offsets)
            pair = np.unique(words.rows * BUCKETS + bucket)  # a document counts a token once: bursts say little
            bucket, label = pair % BUCKETS, toxic[first:last][pair // BUCKETS]
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            for k, value in ((1, 1), (2, 0)):
                counts[k] += np.bincount(bucket[label == value], minlength=BUCKETS)
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(c[used]) for c in counts)], ["bucket", "n", "n_toxic", "n_clean"])


@dataclass
class Scores:
    """Score of each bucket, and the scale of the extreme-value law of segment scores."""

    value: np.ndarray
    scale: float


def log_odds(n: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> Scores:
    prior = PRIOR * (toxic.sum() + clean.sum()) * (n + 1e-3) / (n.sum() + 1e-3 * len(n))
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    value = np.maximum(odds * z**2 / (z**2 + HALF_Z**2), -1.0) - DRIFT
    # Karlin and Altschul: the positive root of sum p exp(scale * value) = 1, where p is the clean text's.
    p = (clean + prior) / (clean + prior).sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(np.minimum(middle * value, 50.0))).sum() < 1 else (low, middle)
    return Scores(value, low)


def segments(position: list[int], value: list[float], total: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last position, score), in linear time.

    Only the positions of positive value are given; total holds the sum of all values up to and with
    each of them.
    """
    # first, last, sum before, sum up to the end, nearest segment before with a smaller sum before
    out: list[tuple[int, int, float, float, int]] = []
    for at, v, upto in zip(position, value, total, strict=True):
        first, last, left, right = at, at, upto - v, upto
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append((first, last, left, right, j))
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in out]


_FEATURES = "key long, body long, n_tokens long, best double, segments array<struct<first:int,last:int,score:double>>"
_SEGMENTS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))


def _segmenter(held):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = held.value
        for batch in batches:
            tokens, best, found = [], [], []
            for _, _, data, offsets in blocks(batch):
                words, bucket = _bucketed(data, offsets)
                value = scores.value[bucket]
                upto = np.cumsum(value)
                positive = np.flatnonzero(value > 0)
                cuts = np.searchsorted(positive, words.first)
                tokens.append(words.counts)
                for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a == b:
                        best.append(0.0)
                        found.append([])
                        continue
                    at = positive[a:b]
                    s = segments((at - words.first[r]).tolist(), value[at].tolist(), upto[at].tolist())
                    best.append(max(x[2] for x in s))
                    found.append([{"first": x[0], "last": x[1], "score": x[2]} for x in s])
            n = pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("body"), n, pa.array(best, pa.float64()), pa.array(found, _SEGMENTS)], ["key", "body", "n_tokens", "best", "segments"])

    return find


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, toxic) of at most ``rows`` labelled rows that aren't held out; a null label or id is none."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    known = known.select(id_key(labels[id_col]).alias("key"), labels[label_col].cast("int").alias("toxic")).groupBy("key").agg(F.max("toxic").alias("toxic"))
    return materialize(known.orderBy(F.xxhash64("key"), "key").limit(rows), "toxic-labels")


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scored(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, train_rows: int) -> DataFrame:
    """(key, body, score, evidence, segments) of rows of (key, body, text)."""
    spark = rows.sparkSession
    known = training_rows(labels, id_col, label_col, train_rows)
    # At most train_rows rows of two numbers: bounded.
    counts = rows.join(F.broadcast(known), "key", "left").mapInArrow(_count, "bucket int, n long, n_toxic long, n_clean long")
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    table = counts.toPandas()  # a row per bucket at most: bounded
    n, toxic, clean = (np.zeros(BUCKETS) for _ in range(3))
    for into, name in ((n, "n"), (toxic, "n_toxic"), (clean, "n_clean")):
        into[table["bucket"].to_numpy(np.int64)] = table[name].to_numpy(float)
    both = bool(toxic.any() and clean.any())
    scores = log_odds(n, toxic, clean) if both else Scores(np.zeros(BUCKETS), 1.0)  # nothing to tell tokens apart by
    held = spark.sparkContext.broadcast(Scores(scores.value.astype(np.float64), scores.scale))
    found = materialize(rows.mapInArrow(_segmenter(held), _FEATURES), "toxic-segments")
    # Gumbel: scale * best - ln(tokens) has its location at ln K; the mean lies Euler's constant above.
    normal = F.col("best") * scores.scale - F.log(F.greatest("n_tokens", F.lit(1)).cast("double"))
    fit = found.join(F.broadcast(known), "key").select("toxic", normal.alias("x"), (F.col("best") > 0).cast("int").alias("any")).toPandas() if both else None
    if fit is None or fit["toxic"].nunique() < 2:
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        probability, evidence = F.lit(float(share)), F.lit(0.0)
    else:
        calm = fit[(fit["toxic"] == 0) & (fit["any"] == 1)]["x"]
        ln_k = float(calm.mean()) - 0.5772 if len(calm) else 0.0
        floor = -np.log(E_VALUE)

        def significant(s: Column) -> Column:
            """-ln of the expected chance segments that score as much, where significant."""
            bits = s * scores.scale - ln_k - F.log(F.greatest("n_tokens", F.lit(1)).cast("double"))
            return F.when(bits > floor, bits - floor).otherwise(0.0)

        evidence = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + significant(s["score"]))
        top = F.greatest(F.col("best") * scores.scale - ln_k - F.log(F.greatest("n_tokens", F.lit(1)).cast("double")) + F.lit(8.0), F.lit(0.0))
        features = [F.lit(1.0), F.log1p(top), F.log1p(evidence), F.log1p(F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + s["score"]))]
        sample = found.join(F.broadcast(known), "key").select("toxic", *[f.alias(f"f{i}") for i, f in enumerate(features)]).toPandas()
        w = _logistic(sample[[f"f{i}" for i in range(len(features))]].to_numpy(float), sample["toxic"].to_numpy(float))
        z = sum((f * float(c) for f, c in zip(features[1:], w[1:], strict=True)), F.lit(float(w[0])))
        probability = 1 / (1 + F.exp(-z))
    p = F.least(F.greatest(probability, F.lit(0.0)), F.lit(1.0)).cast("double")
    return found.select("key", "body", p.alias("score"), evidence.alias("evidence"), "segments")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted, evidence, segments (first, last token, score).

    A null text is empty; an empty text has no segment and the least score. Without labelled rows of
    both kinds every score is the toxic share of the labelled rows, 0 if there are none. An id with
    several labels is toxic if one of them says so. Null ids are not held out; repeated rows each get
    a row; a score depends on the row's text alone; an empty table gives an empty table.
    """
    out = _scored(texts(docs, id_col, text_col), labels, id_col, label_col, train_rows)
    out = out.withColumn(id_col, id_value("key")) if id_col != "key" else out.withColumn("key", id_value("key"))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "segments")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, whatever else stands under their id; null and empty texts stay."""
    toxic = _scored(texts(docs, id_col, text_col), labels, id_col, label_col, train_rows).where("score >= 0.5 AND size(segments) > 0")
    return without(docs, materialize(toxic.select("key", "body"), "toxic"), id_col, text_col)
