"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's shingles are put in one order for the whole corpus, rare ones first (by counts in a
sketch of fixed size over all documents, then by hash). Two sets that are similar enough share a
shingle among their first ones - the prefix - so prefixes are joined on their shingles. The length
filter compares set sizes, the positional filter what can follow the shared shingle, the suffix
filter how the whole sets spread over ranges of hashes. What passes is verified once per pair on the texts.

Groups of many copies are not expanded into all pairs. Sets that are equal are one class, and only
one row of a class goes on. In a prefix group every set is first held against one pivot of about its size, which is linear; the
links found join most of a group into one component. Then only pairs of sets that are still in
different components are held against each other, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._anchors import packed, unpack
from reelspark.llm._components import components
from reelspark.llm._store import id_value, materialize, texts, with_names
from reelspark.llm._text import Bytes, Words, blocks, lower, mix, ngrams, signed, within_rows

#: Words of a shingle.
N = 5
#: Least similarity, in hundredths.
SIMILAR = 80
#: Cells of the sketch of shingle counts; also bounds what is broadcast.
CELLS = 1 << 17
#: Ranges of hashes of which the suffix filter keeps whether a set has an odd number there; 64 in a word.
RANGES = 1024

_U = np.uint64


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a row of fewer than ``n`` words has all of them as one."""
    words = Words(lower(data), offsets)
    hashes = Bytes(lower(data)).slices(words.starts, words.ends)
    ok = within_rows(words, n)
    rows, out = [words.rows[: len(ok)][ok]], [ngrams(hashes, n)[ok]]
    for k in range(1, n):
        short = words.counts == k
        if short.any():
            at = words.first[:-1][short]
            rows.append(np.flatnonzero(short))
            out.append(mix(ngrams(hashes, k)[at] + _U(k)))
    return np.concatenate(rows), np.concatenate(out)


def _sketch(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch):
                _, hashes = _shingles(data, offsets, n)
                counts += np.bincount((hashes & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["cell", "n"])

    return count


def _sets(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, rare first."""
    order = np.lexsort((hashes, counts[(hashes & _U(CELLS - 1)).astype(np.int64)], rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _prefixes(n: int, similar: int, held):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            keys, bodies = batch.column("key").to_numpy(), batch.column("body").to_numpy()
            whole = pa.RecordBatch.from_arrays([pa.array([unpack(x) for x in batch.column("packed").to_pylist()], pa.large_binary())], ["text"])
            for first, last, data, offsets in blocks(whole):
                rows, hashes = _sets(*_shingles(data, offsets, n), counts)
                size = np.bincount(rows, minlength=last - first)
                place = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
                length = size - -(-similar * size // 100) + 1
                keep = place < length[rows]
                rows, hashes, place = rows[keep], hashes[keep], place[keep]
                columns = [signed(hashes), size[rows], keys[first:last][rows], bodies[first:last][rows], place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _PREFIX)

    return cut


_PREFIX = ["seed", "n", "key", "body", "pos"]


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by seed. Rows whose seed has another row; one row waits for the next batch."""
    held: list[np.ndarray] | None = None
    held_again = False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in _PREFIX]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        same = columns[0][1:] == columns[0][:-1]
        again = np.zeros(len(columns[0]), bool)
        again[1:] |= same
        again[:-1] |= same
        again[0] |= held is not None and held_again
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][again[:-1]]) for c in columns], _PREFIX)
        held, held_again = [c[-1:] for c in columns], bool(again[-1])
    if held is not None and held_again:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], _PREFIX)


def _summaries(n: int):
    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(CELLS, np.int64)
        for batch in batches:
            keys, bodies = batch.column("key").to_numpy(), batch.column("body").to_numpy()
            for first, last, data, offsets in blocks(batch):
                rows, hashes = _sets(*_shingles(data, offsets, n), nothing)
                size = np.bincount(rows, minlength=last - first)
                sums = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(salt)), dtype=_U)])
                    ends = np.cumsum(size)
                    sums.append(total[ends] - total[ends - size])
                bits = np.zeros((last - first, RANGES), np.uint8)
                at = rows * RANGES + (hashes >> _U(64 - RANGES.bit_length() + 1)).astype(np.int64)
                np.bitwise_xor.at(bits.reshape(-1), at, 1)
                odd = np.packbits(bits, axis=1).view(np.int64).reshape(-1)
                words = RANGES // 64
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, words, dtype=np.int32)), pa.array(odd))
                yield pa.RecordBatch.from_arrays([pa.array(keys[first:last]), pa.array(bodies[first:last]), pa.array(size), *(pa.array(signed(s)) for s in sums), lists], ["key", "body", "n", "set1", "set2", "odd"])

    return sum_up


def overlap(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.unique(_shingles(raw, np.array([0, len(raw)]), n)[1])


#: A row's name, ordered by its id first: the least one of a component has the smallest id.
_NODE = "struct<key:long,body:long>"


def _verify(n: int, similar: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, held = None, None  # pairs come sorted by b
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                if (now := batch.column("packed_b")[i].as_py()) != body:
                    body, held = now, overlap(unpack(now), n)
                one, other = overlap(unpack(batch.column("packed_a")[i].as_py()), n), held
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * both >= similar * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return check


def _verified(pairs: DataFrame, bodies: DataFrame, n: int, similar: int) -> DataFrame:
    one = pairs.join(bodies.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
    both = one.join(bodies.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
    return both.sortWithinPartitions("b").select("a", "b", "packed_a", "packed_b").mapInArrow(_verify(n, similar), f"a {_NODE}, b {_NODE}")


def _possible(similar: int) -> Column:
    """Length and positional filters of a pair (x, y) that shares the shingle at x.pos and y.pos.

    At the first shingle that a pair shares, ``pos`` bounds what follows. A shingle that stands in one
    prefix only bounds nothing: the other set can have it beyond its own prefix.
    """
    small, large, both = F.least("x.n", "y.n"), F.greatest("x.n", "y.n"), F.col("x.n") + F.col("y.n")
    shared = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (100 + similar) >= both * similar
    return (small * 100 >= large * similar) & shared


def _differ(x: Callable[[int], Column], y: Callable[[int], Column]) -> Column:
    """Ranges in which just one of two sets has an odd number, from the words of their bits."""
    return reduce(lambda a, b: a + b, [F.bit_count(x(i).bitwiseXOR(y(i))) for i in range(RANGES // 64)])


def _suffix_filter(pairs: DataFrame, about: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) whose sets can be near enough: they differ by at least the ranges in which just one of them has an odd number."""
    with_a = pairs.join(about.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    with_b = with_a.join(about.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    differ = _differ(lambda i: F.get("oa", F.lit(i)), lambda i: F.get("ob", F.lit(i)))
    return with_b.where(differ * (100 + similar) <= (F.col("na") + F.col("nb")) * (100 - similar)).select("a", "b").distinct()


def _components(rows: DataFrame, n: int, similar: int) -> DataFrame:
    """(node, n, component) of each row of (key, body, text): its set's size and the least node reachable by links."""
    spark = rows.sparkSession
    cells = rows.mapInArrow(_sketch(n), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(counts)
    node = F.struct("key", "body").alias("node")

    about = rows.mapInArrow(_summaries(n), "key long, body long, n long, set1 long, set2 long, odd array<long>")
    about = materialize(about.select(node, "n", "set1", "set2", "odd"), "sets")
    equal = ["n", "set1", "set2"]
    # Equal sets are linked without a look at their texts; only classes of several need a row here. Written
    # down first, so that the join with it is a plain one and Spark can split a large class.
    first = materialize(about.where("n > 0").groupBy(equal).agg(F.min("node").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "set-classes")
    other = materialize(about.join(first, equal).where(F.col("node") != F.col("rep")).select("node", "rep").distinct(), "set-copies")

    bodies = packed(rows).select(node, "packed").join(other.select("node"), "node", "left_anti").dropDuplicates(["node", "packed"])
    bodies = materialize(bodies, "bodies")
    known = about.join(other.select("node"), "node", "left_anti").select("node", "n", "odd").distinct()

    prefixes = bodies.select("node.*", "packed").mapInArrow(_prefixes(n, similar, held), "seed long, n long, key long, body long, pos int")
    again = prefixes.repartition("seed").sortWithinPartitions("seed").mapInArrow(_several, "seed long, n long, key long, body long, pos int").select("seed", "n", node, "pos")
    again = materialize(again, "prefixes")

    prefix = F.col("n") - F.ceil(F.col("n") * similar / 100) + 1
    lone = again.groupBy("node", "n").agg(F.count("*").alias("c")).select("node", F.greatest(prefix - F.col("c"), F.lit(0)).alias("lone"))
    # A pivot for each size class of a prefix group: the set with the fewest shingles that are in no other
    # prefix. In a cluster of copies of one text that is mostly the one nearest to it; any choice is right.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    classed = again.withColumn("size_class", size_class)
    pivots = classed.join(lone, "node").groupBy("seed", "size_class").agg(F.min(F.struct("lone", F.xxhash64("node").alias("order"), "node", "n", "pos")).alias("p"), F.count("*").alias("members")).where("members > 1")
    pivots = materialize(pivots.select("seed", "size_class", "p.node", "p.n", "p.pos"), "pivots")
    x = classed.alias("x").join(pivots.alias("y"), ["seed", "size_class"])
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    pairs = x.where((F.col("x.node") != F.col("y.node")) & _possible(similar)).select(*ends).distinct()
    pairs = materialize(_suffix_filter(pairs, known, similar), "pivot-pairs")
    links = materialize(_verified(pairs, bodies, n, similar), "pivot-links")
    found = components(links)

    # Sets of a prefix group that are in different components: each but the largest against all others.
    now = again.join(found.withColumnRenamed("key", "node"), "node", "left").select("seed", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    now = materialize(now, "prefix-components")
    mixed = now.groupBy("seed", "component").agg(F.count("*").alias("members")).groupBy("seed").agg(F.max(F.struct("members", "component")).alias("most"), F.count("*").alias("n_components")).where("n_components > 1")
    now = now.join(mixed.select("seed", F.col("most.component").alias("major")), "seed").join(known.select("node", "odd"), "node")
    left, right = now.where("component <> major").alias("x"), now.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.component") < F.col("y.component")))
    # Here the suffix filter is part of the join: what it excludes is never a row.
    near = _differ(lambda i: F.get("x.odd", F.lit(i)), lambda i: F.get("y.odd", F.lit(i))) * (100 + similar) <= (F.col("x.n") + F.col("y.n")) * (100 - similar)
    more = left.join(right, F.col("x.seed") == F.col("y.seed")).where(apart & _possible(similar) & near)
    more = more.select(*ends).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialize(more, "apart-pairs")
    links = links.unionByName(_verified(more, bodies, n, similar))

    every = links.select("a", "b").unionByName(other.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    found = materialize(components(every), "components").withColumnRenamed("key", "node")
    return about.join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similar: int = SIMILAR) -> DataFrame:
    """One row per input row: id, n_shingles (set size), component_id (smallest id reachable by links, itself included).

    A null or empty text has no shingles and no links; a null id is smaller than all others, and
    stays null as a component. Rows are known by id and text: those that share an id are linked only
    if their texts are. A tie, that is equal sets, is a link. An empty table gives an empty table.
    """
    out = _components(texts(docs, id_col, text_col), n, similar)
    return out.select(id_value("node.key").alias(id_col), F.col("n").alias("n_shingles"), id_value("component.key").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similar: int = SIMILAR) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id (null first, then by a hash of the text).

    A row is known by its id and text, so other texts under its id, null or not, are judged for
    themselves. Rows that agree in both are one document; the one of them whose columns have the
    least hash stays. Empty and null texts are near to nothing and stay. An empty table stays empty.
    """
    found = _components(texts(docs, id_col, text_col), n, similar)
    kept = found.where(F.col("node") == F.col("component")).groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept.select(F.col("node.key").alias("kept_key"), F.col("node.body").alias("kept_body"), "rows"), "kept")
    named, key, body = with_names(docs, id_col, text_col)
    rows = lambda some: named.join(some, (named[key] == some["kept_key"]) & (named[body] == some["kept_body"]), "left_semi").select(named["*"])
    once = rows(kept.where("rows = 1")).select(*docs.columns)
    several = rows(kept.where("rows > 1"))
    columns = [several[c] for c in docs.columns]
    one = several.groupBy(several[key], several[body]).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("one")).select("one.*")
    return once.unionByName(one)
