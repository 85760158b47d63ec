"""Vectorised kernels on UTF-8 text in Arrow buffers; each works on one block of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: An odd multiplier, so that its powers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
#: Bytes of text that a kernel takes at once.
BLOCK = 1 << 19


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Bytes:
    """Polynomial prefix sums over a buffer; hashes of any of its slices in constant time each."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        powers, self.inverses = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE_VALUES[buffer] * powers[:n], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Hash of the slice of ``length`` bytes at every start."""
        s = self.sums
        count = max(0, len(s) - length)
        return mix((s[length:] - s[:count]) * self.inverses[:count])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        return mix(value + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours; doubling, so the passes grow with log(width)."""
    if len(keys) < width:
        return keys[:0]
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = np.minimum(out[:-more], out[more:])
    return out


def chosen(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` positions, the one with the least hash, the leftmost on ties."""
    bits = max(1, int(len(hashes)).bit_length())
    keys = (hashes >> _U(bits)) << _U(bits) | np.arange(len(hashes), dtype=_U)
    keys[~valid] = ~_U(0)
    return sliding_min(keys, width) & _U((1 << bits) - 1)


def minimizers(hashes: np.ndarray, valid: np.ndarray, width: int, windows: np.ndarray) -> np.ndarray:
    """Positions that some window chooses.

    hashes: one per position; valid: which positions may be chosen; windows: which starts have a
    whole window of ``width`` positions. Equal windows choose the same offset, wherever they are.
    """
    least = chosen(hashes, valid, width)
    least = least[windows[: len(least)]]
    if not len(least):
        return np.zeros(0, np.int64)
    keep = np.ones(len(least), bool)
    keep[1:] = least[1:] != least[:-1]
    return np.unique(least[keep]).astype(np.int64)


def own_windows(seeds: np.ndarray, at: int, width: int) -> np.ndarray:
    """Starts of the windows that choose position ``at``."""
    return np.flatnonzero(chosen(seeds, np.ones(len(seeds), bool), width) == at)


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about ``size`` bytes."""
    array = batch.column(column)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def runs(sizes: list[int], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of items with about ``size`` bytes."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(sizes, np.int64))])
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + size, "right")) - 1)
        yield first, last
        first = last


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: All but ASCII letters and the bytes of other characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


class Words:
    """The runs of bytes other than ``separators`` (space, tab, newline, VT, FF and CR) in a block of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        joined = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # a word at the end of a row and one at the next row's start
        bounds = np.flatnonzero(edge)
        if len(joined):
            bounds = np.sort(np.concatenate([bounds, joined, joined]))
        self.starts, self.ends = bounds[0::2], bounds[1::2]
        self.first = np.searchsorted(self.starts, offsets)  # the first word of each row, and the end
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbours, rows' borders ignored."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, _U)
    for i in range(n):
        out *= _U(_BASE)
        out += hashes[i : i + count]
    return mix(out)


def slice_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of runs of hashes, wherever they stand."""
    powers, inverses = _power_tables(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * powers[: len(hashes)], dtype=_U)])
    return (sums[ends] - sums[starts]) * inverses[starts]


def window_hashes(hashes: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function of n: the hash of the ``n`` neighbours at every start."""
    count = len(hashes)
    powers, inverses = _power_tables(count + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * powers[:count], dtype=_U)])

    def of(n: int) -> np.ndarray:
        out = np.zeros(count, _U)
        out[: max(0, count - n + 1)] = (sums[n:] - sums[: count + 1 - n]) * inverses[: max(0, count - n + 1)]
        return out

    return of


def within_rows(words: Words, n: int) -> np.ndarray:
    """Which of the ``n`` neighbouring words starting at each word lie in one row."""
    count = max(0, len(words.rows) - n + 1)
    return words.rows[:count] == words.rows[n - 1 :]
