"""Substring dedup by relative Lempel-Ziv parsing, in words.

Documents are factored against reference blocks. A block holds what the corpus has around one seed
(``seed`` words): every window of ``window`` words chooses one of its seeds by least hash, so equal
windows choose the same seed at the same offset, and a document visits exactly the blocks that can
hold a factor of it. Within a block the phrases around the seed are parsed in the order of their
first document: each one's factor is the longest stretch through the seed that an earlier
document's phrase also has. The windows across its boundaries are checked against the block's other
earlier phrases, and give factors of their own, so a window that only another reference has isn't
lost. A phrase that occurs in an earlier document as it is, is one factor.

Each document is then parsed from left to right: the factor that begins here or before and reaches
farthest is taken, and parsing goes on where it ends; words under no factor are literals. Factors
are parts of stretches of ``window`` words or more, and are the duplicate spans.

A block of more than ``most`` different phrases isn't parsed in one task: its phrases are dealt out by
the windows that choose the seed, and each window's first document is its reference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._anchors import FOUND, occurrences, packed, repeated, unpack
from reelspark.llm._store import id_value, materialize, texts
from reelspark.llm._text import Bytes, Words, blocks, chosen, minimizers, mix, ngrams, runs, signed, slice_hashes, within_rows
from reelspark.llm.suffix_dedup import few_and_many

#: Words of a window.
WINDOW = 13
#: Words of a seed.
SEED = 4
#: Different phrases of a block that are parsed in one task; larger blocks are split by windows.
MOST = 500

_U = np.uint64


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(data, offsets)
    return words, Bytes(data).slices(words.starts, words.ends)


def _phrase(hashes: np.ndarray, start: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A phrase's hash: of its words in order, and of where its seed stands."""
    return mix(slice_hashes(hashes, start, end) + mix((at - start).astype(_U) << _U(32) | (end - start).astype(_U)))


def _phrases(window: int, seed: int):
    back, ahead = window - seed, window

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column("key").to_numpy(), batch.column("body").to_numpy()
            for first, last, data, offsets in blocks(batch):
                words, hashes = _word_hashes(data, offsets)
                if len(hashes) < window:
                    continue
                at = minimizers(ngrams(hashes, seed), within_rows(words, seed), window - seed + 1, within_rows(words, window))
                row = words.rows[at]
                begin, end = words.first[row], words.first[row + 1]
                a, b = np.maximum(begin, at - back), np.minimum(end, at + ahead)
                seeds = ngrams(hashes, seed)[at]
                yield occurrences(seeds, _phrase(hashes, a, at, b), keys[first:last][row], bodies[first:last][row], row, at - begin)

    return find


def _cut(window: int, seed: int):
    """The words' hashes of the phrases that are asked for, as bytes; behind: how many stand before the seed."""
    back, ahead = window - seed, window
    numbers = ["seed", "context", "low"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [unpack(x) for x in batch.column("packed").to_pylist()]
            for i, j in runs([*map(len, bodies)]):
                words, hashes = _word_hashes(np.frombuffer(b"".join(bodies[i:j]), np.uint8), np.cumsum([0, *map(len, bodies[i:j])]).astype(np.int64))
                lists = batch.column("wanted").slice(i, j - i)
                asked = lists.flatten()
                row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                first, last = words.first[row], words.first[row + 1]
                at = np.minimum(first + asked.field("pos").to_numpy(), last)
                start, end = np.maximum(at - back, first), np.minimum(at + ahead, last)
                raw, cuts = hashes.tobytes(), zip((start * 8).tolist(), (end * 8).tolist(), strict=True)
                columns = [pa.array((at - start).astype(np.int32)), pa.array([raw[a:b] for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(asked.field(c) for c in numbers), *columns], [*numbers, "behind", "words"])

    return cut


def _shared(one: np.ndarray, before: int, other: np.ndarray, other_before: int) -> tuple[int, int]:
    """How many words two phrases share to the left and right of their seeds."""
    left = right = 0
    a, b = one.tolist(), other.tolist()
    while left < min(before, other_before) and a[before - 1 - left] == b[other_before - 1 - left]:
        left += 1
    while right < min(len(a) - before, len(b) - other_before) and a[before + right] == b[other_before + right]:
        right += 1
    return left, right


def parse(first: list[int], behind: list[int], phrases: list[np.ndarray], window: int, seed: int) -> list[list[tuple[int, int, int]]]:
    """Factors through the seed of each phrase: words to its left, words to its right, first document of the reference.

    first: the first document of each phrase, ascending; a phrase's references are the phrases of
    smaller first documents.
    """
    back, ahead, n = window - seed, window, len(phrases)
    if first[0] == first[-1]:
        return [[] for _ in range(n)]
    if n == 2:
        left, right = _shared(phrases[0], behind[0], phrases[1], behind[1])
        return [[], [(left, right, first[0])] if left + right >= window else []]
    words = np.zeros((n, back + ahead), _U)
    there = np.zeros((n, back + ahead), bool)
    for i, (b, p) in enumerate(zip(behind, phrases, strict=True)):
        words[i, back - b : back - b + len(p)] = p
        there[i, back - b : back - b + len(p)] = True
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    refs = np.searchsorted(np.array(first), first, "left")
    for i in range(n):
        k = int(refs[i])
        if not k:
            continue
        same = (words[:k] == words[i]) & there[:k] & there[i]
        left = np.where(same[:, :back].all(1), back, same[:, :back][:, ::-1].argmin(1))
        right = np.where(same[:, back:].all(1), ahead, same[:, back:].argmin(1))
        length = left + right
        best = int(length.argmax())  # the greedy factor: the longest, of the earliest document on ties
        if length[best] < window:
            continue
        chosen = [best]
        # Its boundaries: windows across them that another reference has.
        for side in (left, right):
            across = np.flatnonzero((length >= window) & (side > side[best]))
            if len(across):
                chosen.append(int(across[side[across].argmax()]))
        out[i] = [(int(left[j]), int(right[j]), first[j]) for j in dict.fromkeys(chosen)]
    return out


def _sorted_blocks(window: int, seed: int):
    """Parses the blocks of a partition that is sorted by seed and first document; a block may go on in the next batch."""

    def settle(rows: list[tuple]) -> list[tuple]:
        found = parse([r[2] for r in rows], [r[3] for r in rows], [np.frombuffer(r[4], _U) for r in rows], window, seed)
        return [(*r[:2], *x) for r, factors in zip(rows, found, strict=True) for x in factors]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seed", "context", "left", "right", "ref"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("seed", "context", "low", "behind", "words")), strict=True):
                if group and group[0][0] != row[0]:
                    out += settle(group)
                    group = []
                if not group or group[-1][1] != row[1]:  # repeated rows lend a phrase twice
                    group.append(row)
            yield batch_of(out)
        if group:
            yield batch_of(settle(group))

    return run


def _windows(window: int, seed: int):
    """The windows that choose each phrase's seed: (window, seed, context, back, low)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("words").to_pylist()
            for i, j in runs([*map(len, every)]):
                phrases, part = every[i:j], batch.slice(i, j - i)
                sizes = np.array([len(x) // 8 for x in phrases], np.int64)
                words, ends = np.frombuffer(b"".join(phrases), _U), np.cumsum(sizes)
                at = ends - sizes + part.column("behind").to_numpy()
                seeds = ngrams(words, seed)
                place = chosen(seeds, np.ones(len(seeds), bool), window - seed + 1).astype(np.int64)
                row = np.repeat(np.arange(j - i), sizes)[: len(place)]
                start = np.flatnonzero((np.arange(len(place)) + window <= ends[row]) & (place == at[row]))
                row = row[start]
                columns = [signed(ngrams(words, window)[start]), *(part.column(c).to_numpy()[row] for c in ("seed", "context")), (at[row] - start).astype(np.int32), part.column("low").to_numpy()[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["window", "seed", "context", "back", "low"])

    return hashed


def _factors(rows: DataFrame, window: int, seed: int, most: int) -> DataFrame:
    """(key, body, found): stretches of ``window`` words or more that an earlier document has, as an array of (start, end, ref), sorted."""
    again = repeated(rows.mapInArrow(_phrases(window, seed), FOUND), "rlz").where("key > first OR multi")
    lent = again.where("multi AND key = first").groupBy("seed", "context").agg(F.min(F.struct("key", "body", "pos")).alias("at"))
    # Seeds whose phrases all are of one document have nothing to lend.
    of_several = again.where("multi").groupBy("seed").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("seed")
    lent = lent.join(of_several, "seed")
    asked = F.struct("seed", "context", F.col("at.key").alias("low"), "at.pos")
    wanted = lent.groupBy("at.key", "at.body").agg(F.collect_list(asked).alias("wanted"))
    phrases = packed(rows).join(wanted, ["key", "body"]).mapInArrow(_cut(window, seed), "seed long, context long, low long, behind int, words binary")
    few, many = few_and_many(materialize(phrases, "rlz-blocks"), most, "rlz")
    settled = few.repartition("seed").sortWithinPartitions("seed", "low", "context").mapInArrow(_sorted_blocks(window, seed), "seed long, context long, left long, right long, ref long")
    every = materialize(many.mapInArrow(_windows(window, seed), "window long, seed long, context long, back int, low long"), "rlz-windows")
    place = ["window", "seed", "back"]
    shared = every.join(every.groupBy(place).agg(F.min("low").alias("ref")), place).where("ref < low")
    # All windows hold the seed, so the outermost two cover what all cover.
    ends = shared.groupBy("seed", "context").agg(F.array(F.min(F.struct("back", "ref")), F.max(F.struct("back", "ref"))).alias("ends"))
    ends = ends.select("seed", "context", F.explode(F.array_distinct("ends")).alias("e"))
    settled = settled.unionByName(ends.select("seed", "context", F.col("e.back").cast("long").alias("left"), (F.lit(window) - F.col("e.back")).cast("long").alias("right"), "e.ref"))

    def stretch(left: Column, right: Column, ref: str) -> Column:
        return F.struct(F.greatest(F.col("pos") - left, F.lit(0)).cast("int").alias("start"), (F.col("last") + right).cast("int").alias("end"), F.col(ref).alias("ref")).alias("x")

    same = again.where("key > first").select("key", "body", stretch(F.lit(window - seed), F.lit(window), "first"))
    mixed = again.where("multi AND key = first").join(settled, ["seed", "context"]).select("key", "body", stretch(F.col("left"), F.col("right"), "ref"))
    return materialize(same.unionByName(mixed).groupBy("key", "body").agg(F.sort_array(F.collect_set("x")).alias("found")), "rlz-found")


def factor(found: list[dict], n: int) -> list[tuple[int, int, int]]:
    """Greedy parse of ``n`` words from left to right: (start, length, ref) of the factors. found: sorted by start."""
    out: list[tuple[int, int, int]] = []
    at, k, end, ref = 0, 0, 0, 0
    while at < n:
        while k < len(found) and found[k]["start"] <= at:
            if found[k]["end"] > end:
                end, ref = found[k]["end"], found[k]["ref"]
            k += 1
        if end > at:
            out.append((at, min(end, n) - at, ref))
            at = end
        elif k < len(found):
            at = found[k]["start"]
        else:
            break
    return out


_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref", pa.int64())]))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            words = unpack(batch.column("packed")[i].as_py()).split()
            factors = factor(batch.column("found")[i].as_py() or [], len(words))
            kept, at = [], 0
            for start, length, _ in factors:
                kept += words[at:start]
                at = start + length
            kept += words[at:]
            left = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode(), [dict(zip(("start", "length", "ref"), f, strict=True)) for f in factors]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], _FACTORS)], ["__key", "n_words", "n_removed", "kept_sha256", "kept", "factors"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, most: int = MOST) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space), factors.

    factors: the parse from left to right, (start, length, ref) in words; ref is an earlier document's
    id (of equally long ones the earliest) that has the factor. A null text has no words; a null id is
    smaller than all others; rows with one id have no smaller one among them, so they lose nothing to
    each other, and each is judged on its own text; an empty table gives an empty table.
    """
    rows = texts(docs, id_col, text_col)
    joined = packed(rows).join(_factors(rows, window, seed, most), ["key", "body"], "left")
    out = joined.mapInArrow(_removed, "__key long, n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<start:long,length:long,ref:long>>")
    # A reference without an id is told by the least number there is.
    return out.select(id_value("__key").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept", "factors")
