"""Phrase collocation mining with counting quotient filters.

Words have ids of 48 bits, from a hash. Every task counts its n-grams in quotient filters, cuts these
into ranges of quotients, and sends the ranges; filters of one range are merged where they meet, and
only phrases that occur often enough leave there. Quotients are spread evenly, and a task sends one
counter for an n-gram however often it saw it, so neither a common phrase nor a large language makes
one range larger than others.

Sizes go up one by one: a phrase can be frequent only if both of its phrases one word shorter are,
so longer n-grams are counted where a filter of 2 ** CELL_BITS bits has those. It lets some others pass,
which costs time alone: counts are exact. The ids of frequent words are then held against the words
themselves; were two to share one, all is counted again with other ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._quotient import BITS, QuotientFilter, merge
from reelspark.llm._store import bound_batches, materialize
from reelspark.llm._text import Bytes, Words, blocks, lower, mix, signed

#: Words of a phrase, at most.
LONGEST = 4
#: Occurrences of a phrase, at least.
LEAST = 30
#: Phrases of a language that are reported.
TOP = 2000
#: A phrase goes if a longer one around it has so many hundredths of its occurrences.
COVER = 80
#: Stands for a null language.
NO_LANG = "und"
#: N-grams that a task counts before it sends its filters, those of a range, and bytes of text for each; there are up to 2 ** 22 ranges.
HELD, RANGE, BYTES = 1 << 20, 1 << 20, 6
#: Bits of the filter of shorter phrases; its size is the same for any input.
CELL_BITS = 24

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(10, 14)]] = True
_COUNTED = "lang string, part int, packed binary"
_PHRASE = "lang string, ids array<long>, a long, cell int"


def _ids(data: np.ndarray, words: Words, salt: int) -> np.ndarray:
    """Ids of words; a salt gives others, from the second on by another kind of hash."""
    if salt < 2:
        return mix(Bytes(data).slices(words.starts, words.ends) + _U(salt)) >> _U(64 - BITS)
    raw = data.tobytes()
    each = (xxhash.xxh3_64_intdigest(raw[a:b], salt) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True))
    return np.fromiter(each, _U, len(words.starts)) >> _U(64 - BITS)


def _cells(ids: np.ndarray, lang: str) -> np.ndarray:
    """The cell of each phrase of a language in the filter of 2 ** CELL_BITS bits."""
    out = np.full(ids.shape[1], xxhash.xxh3_64_intdigest(lang.encode()), _U)
    for x in ids:
        out = mix(out + x)
    return (out >> _U(64 - CELL_BITS)).astype(np.int64)


def _has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def _read(batch: pa.RecordBatch, salt: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]]:
    """(language, ids, pieces, which words, all words, bytes) of each language in each block; words of one piece have one number."""
    langs = batch.column("lang").dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    for first, last, data, offsets in blocks(batch):
        data = lower(data)
        words = Words(data, offsets, _SPACE | _STOP)
        if not len(words.starts):
            continue
        ids = _ids(data, words, salt)
        pieces = np.cumsum(_STOP[data])[words.starts] + words.rows
        own = codes[first:last][words.rows]
        for code in np.unique(own).tolist():
            at = np.flatnonzero(own == code)
            yield names[code], ids[at], pieces[at], at, words, data


def _count(n: int, part_bits: int, salt: int, held: Broadcast | None):
    """Rows of _COUNTED: each task's filters of n-grams, cut into ranges."""

    def send(waiting: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, some in waiting.items():
            rows = [(lang, part, f.pack(part_bits)) for part, f in QuotientFilter.of(np.hstack(some)).ranges(part_bits)]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "part", "packed"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("part", pa.int32()), ("packed", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = defaultdict(list), 0
        for batch in batches:
            for lang, ids, pieces, *_ in _read(batch, salt):
                count = len(ids) - n + 1
                if count < 1:
                    continue
                ok = pieces[:count] == pieces[n - 1 :]
                if held is not None:
                    shorter = _has(held.value, _cells(np.stack([ids[i : i + count + 1] for i in range(n - 1)]), lang))
                    ok &= shorter[:-1] & shorter[1:]
                at = np.flatnonzero(ok)
                if len(at):
                    waiting[lang].append(np.stack([ids[at + i] for i in range(n)]))
                    size += len(at)
                if size >= HELD:
                    yield from send(waiting)
                    waiting, size = defaultdict(list), 0
        yield from send(waiting)

    return run


def _merge(least: int):
    """Rows of _PHRASE of one language and range: the frequent phrases, and under no ids the number of all occurrences."""

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        every = merge(QuotientFilter.unpack(x.as_py()) for x in table.column("packed"))
        often = np.flatnonzero(every.counts >= _U(least))
        ids, counts = QuotientFilter(every.keys[:, often], every.counts[often]).ids(), every.counts[often]
        flat = pa.array(signed(np.ascontiguousarray(ids.T).reshape(-1)))
        offsets = pa.array(np.append(0, np.arange(len(often) + 1) * ids.shape[0]).astype(np.int32))
        return pa.table({"lang": pa.array([lang] * (len(often) + 1), pa.string()), "ids": pa.ListArray.from_arrays(offsets, flat), "a": pa.array([int(every.counts.sum()), *counts.tolist()], pa.int64()), "cell": pa.array([-1, *_cells(ids, lang).tolist()], pa.int32())})

    return run


def _filter(phrases: DataFrame) -> np.ndarray:
    """The bits of the phrases' cells; 2 ** CELL_BITS / 32 rows of 12 bytes at most are collected."""
    found = phrases.groupBy(F.shiftright("cell", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cell & 31)")).alias("bits")).toPandas()
    bits = np.zeros(1 << (CELL_BITS - 5), np.uint32)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits.view(np.uint8)


def _same_words(data: np.ndarray, words: Words, at: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which words ``at`` have the bytes of the words ``like``."""
    sizes = words.ends[at] - words.starts[at]
    same = sizes == words.ends[like] - words.starts[like]
    at, like, sizes = at[same], like[same], sizes[same]
    if len(at):
        upto = np.cumsum(sizes)
        step = np.arange(upto[-1]) - np.repeat(upto - sizes, sizes)
        equal = data[np.repeat(words.starts[at], sizes) + step] == data[np.repeat(words.starts[like], sizes) + step]
        same[same] = np.logical_and.reduceat(equal, upto - sizes)
    return same


def _dictionary(salt: int, held: Broadcast):
    """(lang, id, word) of the words that the filter has, each about once for HELD words of a task.

    Bytes are compared, not hashes: of words that share an id, both are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = defaultdict(dict), 0
        for batch in batches:
            for lang, ids, _, at, words, data in _read(batch, salt):
                ok = _has(held.value, _cells(ids[None], lang))
                ids, at = ids[ok], at[ok]
                names, first, which = np.unique(ids, return_index=True, return_inverse=True)
                listed = np.append(first, np.flatnonzero(~_same_words(data, words, at, at[first][which])))
                raw, known = data.tobytes(), seen[lang]
                new = []
                for i, a, b in zip(ids[listed].tolist(), words.starts[at[listed]].tolist(), words.ends[at[listed]].tolist(), strict=True):
                    if known.get(i) != raw[a:b]:
                        known[i] = raw[a:b]
                        new.append((i, known[i].decode()))
                size += len(ids)
                if new:
                    numbers, spelled = zip(*new, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array(numbers, pa.int64()), pa.array(spelled, pa.string())], ["lang", "id", "word"])
                if size >= HELD:
                    seen, size = defaultdict(dict), 0

    return run


def _counted(rows: DataFrame, longest: int, least: int, salt: int) -> tuple[list[DataFrame], DataFrame, DataFrame] | None:
    """(phrases of 1, 2, ... words; words of each language; ids and words), or nothing if two words share an id."""
    spark = rows.sparkSession
    most = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).agg(F.max("size")).first()[0] or 0
    part_bits = min(22, max(4, (most // (BYTES * RANGE)).bit_length()))
    held, levels, sizes, names = None, [], None, None
    for n in range(1, longest + 1):
        packed = rows.mapInArrow(_count(n, part_bits, salt, held), _COUNTED)
        found = materialize(packed.groupBy("lang", "part").applyInArrow(_merge(least), _PHRASE), f"collocations-{n}")
        levels.append(found.where("cell >= 0").select("lang", "ids", "a", "cell"))
        if n == 1:
            sizes = found.where("cell < 0").groupBy("lang").agg(F.sum("a").alias("n"))
        if n < longest:
            held = spark.sparkContext.broadcast(_filter(levels[-1]))
        if n == 1:
            known = levels[0].select(F.col("lang").alias("l"), F.element_at("ids", 1).alias("i"))
            listed = rows.mapInArrow(_dictionary(salt, held), "lang string, id long, word string").distinct()
            names = materialize(listed.join(known, (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i")), "left_semi"), "collocations-words")
            if names.groupBy("lang", "id").count().where("count > 1").limit(1).count():
                return None
    return levels, sizes, names


def _exact(x: Column, digits: int = 19) -> Column:
    return x.cast(f"decimal({digits},0)")


def _scored(phrases: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, score): each candidate's lowest-scoring cut, the shortest first part on ties."""
    cuts = phrases.where(F.size("ids") > 1).select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        known = phrases.select(F.col("lang").alias("of"), F.col("ids").alias("part"), F.col("a").alias(name))
        cuts = cuts.join(known, (F.col("lang") == F.col("of")) & (F.col(part) == F.col("part"))).drop("of", "part")
    cuts = cuts.select("lang", "ids", "a", "k", "l", "r", (_exact(F.lit(2_000_000), 7) * _exact(F.col("a"))).alias("up"), (_exact(F.col("l")) + _exact(F.col("r"))).alias("down"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def _uncovered(scored: DataFrame, longest: int, cover: int) -> DataFrame:
    """The candidates that no longer one around them covers."""
    spans = [(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
    inside = scored.where(F.size("ids") > 2).select("lang", "a", F.explode(F.array(*[F.when((F.lit(i + n - 1) <= F.size("ids")) & (F.lit(n) < F.size("ids")), F.slice("ids", i, n)) for i, n in spans])).alias("part")) if spans else scored.select("lang", "a", F.col("ids").alias("part")).limit(0)
    around = inside.where("part IS NOT NULL").groupBy(F.col("lang").alias("of"), "part").agg(F.max("a").alias("around"))
    out = scored.join(around, (F.col("lang") == F.col("of")) & (F.col("ids") == F.col("part")), "left")
    return out.where(F.col("around").isNull() | (_exact(F.col("around")) * 100 < _exact(F.col("a")) * cover)).drop("of", "part", "around")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words, for each language best first.

    Words are runs without space or tab, A-Z lowered; stops and line ends cut a text into pieces, and
    phrases lie within one. ``a`` is how often a phrase occurs, at least ``least``; ``l`` and ``r`` the
    same of the two parts of its worst cut, ``n`` all words of the language, the score
    2,000,000 a / (l + r), rounded down. A phrase inside a longer one with ``cover`` hundredths of its
    occurrences is left out. ``top`` phrases of a language are returned, None for all; ties go to the
    more frequent, then to the first in byte order. A null text is empty, a null language ``und``;
    repeated rows count as often as they stand there, ids play no part. An empty table, and one without
    frequent phrases, give none.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    salt, counted = 0, None
    while counted is None:
        counted, salt = _counted(rows, longest, least, salt), salt + 1
    levels, sizes, names = counted
    phrases = reduce(DataFrame.unionByName, levels).drop("cell")
    scored = materialize(_scored(phrases), "collocations-scored")
    kept = _uncovered(scored, longest, cover)
    if top is not None:  # with ties, which only the words can settle
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        kept = kept.withColumn("at", F.rank().over(order)).where(F.col("at") <= top).drop("at")
    spelled = kept.select("*", F.posexplode("ids").alias("pos", "id")).join(names.select(F.col("lang").alias("of"), F.col("id").alias("i"), "word"), (F.col("lang") == F.col("of")) & (F.col("id") == F.col("i")))
    spelled = spelled.groupBy("lang", "ids", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    spelled = spelled.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
