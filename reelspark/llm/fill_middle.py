"""Fill-in-middle: a text is cut in three and its middle moved to the end.

Cuts stand at borders of units (lines, words or characters). A Fenwick tree over fixed blocks of a
text's bytes holds how many units end in them and how many code points they have. A binary-lifting
descent finds the block in which the k-th unit ends, and what stands before it, in as many steps as
the number of blocks has bits; the border itself is then looked up in that one block. Only the
places of the cuts come from Python; texts are put together, and restored, by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reelspark.llm._store import bound_batches
from reelspark.llm._text import SPACE, blocks

#: Bytes of a block of the tree.
BLOCK_BYTES = 4096
#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")


def _heads(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def _before(flags: np.ndarray) -> np.ndarray:
    """Whether the next byte is flagged."""
    return np.append(flags[1:], False)


#: Bytes after which a unit ends; the last byte of a text ends one too.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "line": lambda data: data == 10,
    "word": lambda data: SPACE[data] & _before(~SPACE[data]),
    "char": lambda data: _before(_heads(data)),
}


class BlockTree:
    """Fenwick tree over a text's blocks: node i sums units and code points of the i & -i blocks that end with block i."""

    def __init__(self, ends: np.ndarray, heads: np.ndarray, size: int = BLOCK_BYTES):
        self.ends, self.heads, self.size = ends, heads, size
        starts = np.arange(0, len(ends), size)
        self.sums = np.zeros((len(starts) + 1, 2), np.int64)
        if len(starts):
            self.sums[1:, 0] = np.add.reduceat(ends, starts, dtype=np.int64)
            self.sums[1:, 1] = np.add.reduceat(heads, starts, dtype=np.int64)
        step = 1
        while step * 2 <= len(starts):
            above = self.sums[step * 2 :: step * 2]
            above += self.sums[step :: step * 2][: len(above)]
            step *= 2

    def total(self) -> tuple[int, int]:
        """Units and code points of the text."""
        at, units, chars = len(self.sums) - 1, 0, 0
        while at:
            units, chars = units + int(self.sums[at, 0]), chars + int(self.sums[at, 1])
            at &= at - 1
        return units, chars

    def chars_through(self, k: int) -> int:
        """Code points of the first ``k`` units, 0 <= k <= all."""
        if k <= 0:
            return 0
        at, chars, step = 0, 0, 1 << (len(self.sums) - 1).bit_length()
        while step:
            if at + step < len(self.sums) and self.sums[at + step, 0] < k:
                at += step
                k, chars = k - int(self.sums[at, 0]), chars + int(self.sums[at, 1])
            step >>= 1
        first = at * self.size
        end = first + int(np.flatnonzero(self.ends[first : first + self.size])[k - 1]) + 1
        return chars + int(np.count_nonzero(self.heads[first:end]))


_CUTS = "struct<n:long,prefix:long,middle:long>"


def _cuts(unit: str, size: int):
    ends_of = UNITS[unit]

    @arrow_udf(_CUTS)
    def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        out = np.zeros((len(text), 3), np.int64)
        draws = np.stack([one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)], axis=1)
        for first, _, data, offsets in blocks(pa.RecordBatch.from_arrays([text], ["text"])):
            ends, heads = ends_of(data), _heads(data)
            ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), first):
                tree = BlockTree(ends[a:b], heads[a:b], size)
                n, _ = tree.total()
                low, high = sorted((draws[i] % (n + 1)).tolist())
                prefix = tree.chars_through(low)
                out[i] = n, prefix, tree.chars_through(high) - prefix
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T.copy()], ["n", "prefix", "middle"])

    return cuts


def _distinct(markers: tuple[str, str, str]) -> None:
    """Raises where a marker could be found too early, across the border of a text and the next marker."""
    for x in markers:
        for y in markers:
            if not x or (x != y and x in y) or any(y.startswith(x[i:]) for i in range(1, len(x))):
                raise ValueError(f"markers {x!r} and {y!r} overlap")


def _part(text: Column, start: Column, size: Column) -> Column:
    return text.substr(start.cast("int"), size.cast("int"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS, block: int = BLOCK_BYTES) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row.

    ``n`` units are cut at two places that a hash of ``seed`` and the id draws; ``rate`` of 100 texts
    are changed, ``spm_rate`` of 100 of these with the suffix first (form spm, else psm). A text that
    is empty or null, or holds a marker, stays as it is (form plain, no counts). Rows that share an
    id draw the same numbers, each for its own text; a null id draws those of an empty one. There is
    no exchange: a row's result depends on that row alone.
    """
    _distinct(markers)
    bound_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), *[F.conv(name.substr(8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    rows = rows.select("*", _cuts(unit, block)("text", "h1", "h2").alias("cut"))
    marked = [F.col("text").contains(m) for m in markers]
    plain = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (F.col("h3") % 100 >= rate)
    rows = rows.select("id", "text", "cut", F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm").alias("form"))
    body, one, two = F.col("text"), F.col("cut.prefix"), F.col("cut.prefix") + F.col("cut.middle")
    prefix, middle, suffix = _part(body, F.lit(1), one), _part(body, one + 1, F.col("cut.middle")), _part(body, two + 1, F.length(body) - two)
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("form") == "plain", body).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    return rows.select(F.col("id").alias(id_col), F.col("cut.n").alias("n"), "form", F.when(moved, one).alias("prefix_chars"), F.when(moved, F.col("cut.middle")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``transform`` made an output from, by its markers and form."""
    _distinct(markers)
    p, s, m = markers
    psm = form == "psm"
    begin = F.when(psm, F.lit(len(p))).otherwise(F.lit(len(s))) + 1
    second = F.when(psm, F.instr(output, s)).otherwise(F.instr(output, p))
    after = second + F.when(psm, F.lit(len(s))).otherwise(F.lit(len(p)))
    last = F.instr(output, m)
    one, two = _part(output, begin, second - begin), _part(output, after, last - after)
    middle = _part(output, last + len(m), F.length(output))
    return F.when(form == "plain", output).when(psm, F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digest(made: DataFrame, id_col: str = "doc_id", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Of ``transform``'s rows: the counts, and hashes of the output and of the text restored from it."""
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), markers), 256).alias("restored_sha256"))
