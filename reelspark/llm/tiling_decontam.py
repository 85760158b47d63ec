"""Benchmark decontamination by greedy string tiling.

Words of a document and of a benchmark item that share a seed (``least`` words in a row, by running
Karp-Rabin hash) are joined on it. The longest stretch that both have is marked, again and again,
until none of ``least`` words is left; marked words are not used twice. The share of the item's
words under tiles decides: the tiles may come in any order, so reordered passages are caught too.

The corpus is read once, however many items there are: a filter of fixed size over the items' seeds
goes to every task, and only what passes it, stretches of seeds, takes part in the join. An item is looked up by
its rarer seeds alone: the most common ones, as long as they cover less of it than a contamination needs, are
left out, so prompt lines that many items and documents share form no pairs.

An item of fewer than ``least`` words is too short to tell where it stands in a text: it only
contaminates documents that consist of it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._store import bound_batches, id_key, id_value, materialize, text_hash, texts, without
from reelspark.llm._text import Bytes, Words, blocks, lower, mix, ngrams, signed, window_hashes, within_rows

#: Words of the shortest tile.
LEAST = 5
#: Share of an item's words under tiles from which a document is contaminated.
COVERAGE = 0.5
#: log2 of the bits of the filter of items' seeds: bounds what is collected and broadcast to 2 MB.
FILTER_BITS = 24

_U = np.uint64
_TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    low = lower(data)
    words = Words(low, offsets)
    return words, Bytes(low).slices(words.starts, words.ends)


def _seeds(words: Words, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(word at which it starts, hash) of every seed; a row of fewer words has all of them as one."""
    at, out = [np.flatnonzero(within_rows(words, least))], []
    out.append(ngrams(hashes, least)[at[0]])
    for k in range(1, least):
        short = words.first[:-1][words.counts == k]
        if len(short):
            at.append(short)
            out.append(mix(ngrams(hashes, k)[short] + _U(k)))
    at, out = np.concatenate(at), np.concatenate(out)
    order = np.argsort(at, kind="stable")
    return at[order], out[order]


def _items(least: int):
    """Words and seeds of the items: (item_row, item, n_words, words, seeds, places)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items = batch.column("item_row"), batch.column("item")
            for first, last, data, offsets in blocks(batch):
                words, hashes = _hashed(data, offsets)
                at, seeds = _seeds(words, hashes, least)
                cuts = np.searchsorted(at, words.first)
                own = [hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                places = (at - words.first[words.rows[at]]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v)) for v in (signed(seeds), places)]
                yield pa.RecordBatch.from_arrays([rows.slice(first, last - first), items.slice(first, last - first), pa.array(words.counts), pa.array(own, pa.binary()), *lists], ["item_row", "item", "n_words", "words", "seeds", "places"])

    return read


def _stretches(least: int, held):
    """Stretches of documents' words whose seeds pass the filter: (key, body, seeds, starts, sizes, words)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            keys, bodies = batch.column("key").to_numpy(), batch.column("body").to_numpy()
            for first, _, data, offsets in blocks(batch):
                words, hashes = _hashed(data, offsets)
                at, seeds = _seeds(words, hashes, least)
                cell = (seeds & _U((1 << FILTER_BITS) - 1)).astype(np.int64)
                hit = np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                at, seeds = at[hit], seeds[hit]
                row = words.rows[at]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
                begins = np.flatnonzero(new)
                ends = np.minimum(at[np.append(begins[1:], len(at))[: len(begins)] - 1] + least, words.first[row[begins] + 1])
                starts, owner = at[begins], row[begins]
                out = []
                for r, (a, b), (c, d) in zip(np.unique(row), _runs(owner), _runs(row), strict=True):
                    spans = list(zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
                    mine = b"".join(hashes[x:y].tobytes() for x, y in spans)
                    out.append((keys[first + r], bodies[first + r], signed(np.unique(seeds[c:d])), [x - int(words.first[r]) for x, _ in spans], [y - x for x, y in spans], mine))
                columns = list(zip(*out, strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["key", "body", "seeds", "starts", "sizes", "words"])

    return find


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_)], strict=True)) if len(sorted_) else []


def _room(free: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many free words follow each place, itself included, up to the end of its stretch (``last`` marks the ends)."""
    n = len(free)
    stop = np.where(~free, np.arange(n), np.where(last, np.arange(n) + 1, n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def tile(item: np.ndarray, starts: list[int], stretches: list[np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length), longest first, of equal ones the first in the item, then in the document.

    item: hashes of its words; stretches: hashes of the document's words from each of ``starts`` on.
    Lengths are found by bisection over running hashes, so repeated words cost no pairs of places.
    """
    starts, stretches = [s for s, x in zip(starts, stretches, strict=True) if len(x)], [x for x in stretches if len(x)]
    doc = np.concatenate([*stretches, np.zeros(0, _U)]).astype(_U)
    place = np.concatenate([*(np.arange(s, s + len(x)) for s, x in zip(starts, stretches, strict=True)), np.zeros(0, np.int64)]).astype(np.int64)
    ends = np.zeros(len(doc), bool)
    ends[np.cumsum([len(x) for x in stretches], dtype=np.int64) - 1] = True
    item_end = np.zeros(len(item), bool)
    item_end[-1:] = True
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    of_item, of_doc = window_hashes(item), window_hashes(doc)
    tiles = []
    high = min(len(item), len(doc))
    while True:
        room_item, room_doc = _room(free_item, item_end), _room(free_doc, ends)

        def common(n: int, room_item=room_item, room_doc=room_doc) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            i, j = np.flatnonzero(room_item >= n), np.flatnonzero(room_doc >= n)
            a, b = of_item(n)[i], of_doc(n)[j]
            return i, a, j, b

        low, high = least - 1, min(high, int(room_item.max(initial=0)), int(room_doc.max(initial=0)))
        while low < high:
            middle = (low + high + 1) // 2
            _, a, _, b = common(middle)
            low, high = (middle, high) if np.isin(a, b).any() else (low, middle - 1)
        if low < least:
            return sorted(tiles)
        i, a, j, b = common(low)
        wanted: dict[int, list[int]] = defaultdict(list)
        of = np.isin(b, a)
        for x, y in zip(b[of][::-1].tolist(), j[of][::-1].tolist(), strict=True):
            wanted[x].append(y)  # the first place is the last of the list
        for x, at in zip(a.tolist(), i.tolist(), strict=True):
            places = wanted.get(x)
            if not places or not free_item[at : at + low].all():
                continue
            while places and not free_doc[places[-1] : places[-1] + low].all():
                places.pop()
            if places:
                k = places.pop()
                free_item[at : at + low] = False
                free_doc[k : k + low] = False
                tiles.append((at, int(place[k]), low))


def _tiled(least: int, coverage: float):
    names = ["key", "body", "item", "n_words", "n_covered", "n_tiles", "tiles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, cuts = np.frombuffer(r["words"], _U), np.cumsum(r["sizes"])[:-1]
                tiles = tile(np.frombuffer(r["item_words"], _U), r["starts"], np.split(words, cuts), min(least, r["n_words"]))
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * r["n_words"]:
                    out.append((r["key"], r["body"], r["item"], r["n_words"], covered, len(tiles), [dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in tiles]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], _TILES)], names)

    return run


def _filter(items: DataFrame) -> np.ndarray:
    """The bits of the items' seeds; 2 ** FILTER_BITS / 64 rows at most are collected."""
    cells = items.select(F.explode("seeds").alias("seed")).select(F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("cell"))
    words = cells.groupBy(F.shiftright("cell", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def _indexed(least: int, coverage: float):
    """(item_row, seed): the seeds by which an item is looked up. Those left out, the most common first, cover too little
    of the item for a contamination, so a document that contaminates has one of the others. An item whose
    seeds that occur at all cover too little has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds = [], []
            for item, n, spots in zip(*(batch.column(c).to_pylist() for c in ("item_row", "n_words", "spots")), strict=True):
                size, covered, left, kept = min(least, n), np.zeros(n, bool), 0, []
                for s in sorted(spots, key=lambda s: (-s["cost"], s["place"])):
                    part = covered[s["place"] : s["place"] + size]
                    new = size - int(np.count_nonzero(part))
                    if left + new < coverage * n:
                        left += new
                        part[:] = True
                    else:
                        kept.append(s["seed"])
                rows += [item] * len(set(kept))
                seeds += sorted(set(kept))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(seeds, pa.int64())], ["item_row", "seed"])

    return run


def _candidates(items: DataFrame, found: DataFrame, least: int, coverage: float) -> DataFrame:
    """(row, item_row) of the pairs that share an indexed seed: a line that many items and documents have forms no pairs by itself."""
    of_docs = found.select("row", F.explode("seeds").alias("seed"))
    of_items = items.select("item_row", "n_words", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item_row", "n_words", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    in_items, in_docs = of_items.groupBy("seed").agg(F.count(F.lit(1)).alias("n_items")), of_docs.groupBy("seed").agg(F.count(F.lit(1)).alias("n_docs"))
    cost = materialize(in_items.join(in_docs, "seed").select("seed", (F.col("n_items").cast("double") * F.col("n_docs")).alias("cost")), "tiling-seeds")
    spots = of_items.join(cost, "seed").groupBy("item_row", "n_words").agg(F.collect_list(F.struct("cost", "place", "seed")).alias("spots"))
    index = materialize(spots.mapInArrow(_indexed(least, coverage), "item_row long, seed long"), "tiling-index")
    return of_docs.join(index, "seed").select("row", "item_row").distinct()


def _contaminated(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, least: int, coverage: float) -> DataFrame:
    """(key, body, item, n_words, n_covered, n_tiles, tiles) of the contaminated pairs, for each row of (key, body, text)."""
    bench = benchmark.select(F.xxhash64(id_key(benchmark[item_col]), text_hash(benchmark[item_text_col])).alias("item_row"), id_key(benchmark[item_col]).alias("item"), F.coalesce(benchmark[item_text_col], F.lit("")).alias("text"))
    bench = bench.dropDuplicates(["item_row"]).mapInArrow(_items(least), "item_row long, item long, n_words long, words binary, seeds array<long>, places array<int>")
    items = materialize(bench.where("n_words > 0"), "tiling-items")
    held = rows.sparkSession.sparkContext.broadcast(_filter(items))
    found = rows.mapInArrow(_stretches(least, held), "key long, body long, seeds array<long>, starts array<int>, sizes array<int>, words binary")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "tiling-stretches")

    pairs = _candidates(items, found, least, coverage)
    pairs = pairs.join(items.select("item_row", "item", "n_words", F.col("words").alias("item_words")), "item_row").join(found.drop("seeds"), "row")
    return pairs.select("key", "body", "item", "n_words", "item_words", "starts", "sizes", "words").mapInArrow(_tiled(least, coverage), "key long, body long, item long, n_words long, n_covered long, n_tiles long, tiles array<struct<item_start:int,doc_start:int,length:int>>")


def tiles_with(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated pair: id, item id, n_words (the item's), n_covered, n_tiles, coverage, tiles.

    Words are runs of other than ASCII white space, A-Z in lower case. Null and empty texts, of
    either side, match nothing; null ids stay null; a repeated row has its own rows, a repeated item
    counts once; of equal tiles the first in the item, then in the document is taken first; an empty
    table gives an empty table. Tiles are (item_start, doc_start, length) in words.
    """
    bound_batches(docs.sparkSession)
    out = _contaminated(texts(docs, id_col, text_col), benchmark, item_col, item_text_col, least, coverage)
    return out.select(id_value("key").alias(id_col), id_value("item").alias(item_col), "n_words", "n_covered", "n_tiles", (F.col("n_covered") / F.col("n_words")).alias("coverage"), "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, whatever else stands under their id; null and empty texts stay."""
    hit = _contaminated(texts(docs, id_col, text_col), benchmark, item_col, item_text_col, least, coverage)
    return without(docs, materialize(hit.select("key", "body"), "contaminated"), id_col, text_col)
