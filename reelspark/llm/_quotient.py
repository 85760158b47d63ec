"""Counting quotient filters of packed word-id n-grams: compact counters that lose nothing.

A key is n word ids of ``BITS`` bits. Its first id is permuted with the others mixed in, which can be
undone, so the key's leading bits are spread evenly whatever the words are. The first of them are the
quotient, all the rest the remainder. A stored filter has one bit for each quotient of its range (does
it occur), one bit for each entry (does its quotient's run end here), the remainders in order, and
the counts in a byte each, larger ones apart. Quotient and remainder give the key back, so equal keys
are counted together and different ones never. Filters are sorted, and are merged by one pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from reelspark.llm._text import mix

_U = np.uint64
#: Bits of a word id.
BITS = 48
_MASK = _U((1 << BITS) - 1)
_HALF = _U(BITS // 2)
#: Odd, so each has an inverse modulo 2 ** BITS.
_ODD = (0xD1B54A32D193, 0x9E3779B97F4B)
_HEAD = struct.Struct("<BBBQQ")


def _tail(keys: np.ndarray) -> np.ndarray:
    """A number of ``BITS`` bits from all ids of a key but the first."""
    out = np.zeros(keys.shape[1], _U)
    for x in keys[1:]:
        out = mix(out ^ x) + x
    return out & _MASK


def permuted(ids: np.ndarray) -> np.ndarray:
    """Ids, one row for each place of the n-gram, with the first row spread over all values."""
    x = (ids[0] + _tail(ids)) & _MASK
    for odd in _ODD:
        x = ((x ^ (x >> _HALF)) * _U(odd)) & _MASK
    return np.vstack([(x ^ (x >> _HALF))[None], ids[1:]])


def restored(keys: np.ndarray) -> np.ndarray:
    """The ids of permuted keys."""
    x = keys[0] ^ (keys[0] >> _HALF)
    for odd in _ODD[::-1]:
        x = (x * _U(pow(odd, -1, 1 << BITS))) & _MASK
        x ^= x >> _HALF
    return np.vstack([((x - _tail(keys)) & _MASK)[None], keys[1:]])


def _reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, counts of equal ones added up."""
    if keys.shape[1] < 2:
        return keys, counts
    order = np.argsort(keys[0], kind="stable")
    keys = keys[:, order]
    same, alike = keys[0, 1:] == keys[0, :-1], np.ones(keys.shape[1] - 1, bool)
    for x in keys[1:]:
        alike &= x[1:] == x[:-1]
    if (same & ~alike).any():  # other keys of one first row: rare, as it is spread over 2 ** BITS values
        again = np.lexsort(keys[::-1])
        keys, order = keys[:, again], order[again]
        same = np.ones(keys.shape[1] - 1, bool)
        for x in keys:
            same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.append(True, ~same))
    return keys[:, first], np.add.reduceat(counts[order], first)


def _as_bytes(x: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bytes of numbers, highest first."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def _as_numbers(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - raw.shape[1] :] = raw
    return wide.reshape(-1).view(">u8").astype(_U)


class QuotientFilter:
    """Distinct keys in ascending order and how often each occurs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def __len__(self) -> int:
        return self.keys.shape[1]

    @classmethod
    def of(cls, ids: np.ndarray) -> QuotientFilter:
        """Counts n-grams, given as one row of ids for each of their places."""
        return cls(*_reduced(permuted(ids), np.ones(ids.shape[1], _U)))

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        return QuotientFilter(*_reduced(np.hstack([self.keys, other.keys]), np.concatenate([self.counts, other.counts])))

    def ids(self) -> np.ndarray:
        return restored(self.keys)

    def ranges(self, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """Itself in 2 ** ``bits`` equal ranges of quotients; empty ranges are left out."""
        own = (self.keys[0] >> _U(BITS - bits)).astype(np.int64)
        present, starts = np.unique(own, return_index=True)
        for at, a, b in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self)], strict=True):
            yield at, QuotientFilter(self.keys[:, a:b], self.counts[a:b])

    def pack(self, bits: int) -> bytes:
        """Stored form of a filter whose keys lie in one of 2 ** ``bits`` ranges."""
        n, entries = self.keys.shape
        quotient_bits = min(BITS, max(bits // 8 * 8 + 8, (bits + entries.bit_length()) // 8 * 8))  # whole bytes, and about as many quotients as entries
        quotients = (self.keys[0] >> _U(BITS - quotient_bits)).astype(np.int64)
        at = int(quotients[0] >> (quotient_bits - bits)) if entries else 0
        occupied = np.zeros(1 << (quotient_bits - bits), bool)
        occupied[quotients - (at << (quotient_bits - bits))] = True
        ends = np.append(quotients[1:] != quotients[:-1], True) if entries else np.zeros(0, bool)
        columns = [_as_bytes(self.keys[0], (BITS - quotient_bits) // 8), *[_as_bytes(x, BITS // 8) for x in self.keys[1:]]]
        small = np.where(self.counts < 256, self.counts, _U(0)).astype(np.uint8)
        head = _HEAD.pack(n, bits, quotient_bits, at, entries)
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns], small.tobytes(), self.counts[self.counts >= 256].tobytes()])

    @classmethod
    def unpack(cls, raw: bytes) -> QuotientFilter:
        n, bits, quotient_bits, at, entries = _HEAD.unpack_from(raw)
        data, place = np.frombuffer(raw, np.uint8), _HEAD.size

        def take(size: int) -> np.ndarray:
            nonlocal place
            place += size
            return data[place - size : place]

        span = 1 << (quotient_bits - bits)
        occupied = np.flatnonzero(np.unpackbits(take(-(-span // 8)), count=span)) + (at << (quotient_bits - bits))
        ends = np.unpackbits(take(-(-entries // 8)), count=entries).astype(np.int64)
        width = (BITS - quotient_bits) // 8
        remainder = _as_numbers(take(entries * width).reshape(entries, width))
        rest = [_as_numbers(take(entries * (BITS // 8)).reshape(entries, BITS // 8)) for _ in range(n - 1)]
        counts = take(entries).astype(_U)
        counts[counts == 0] = np.frombuffer(raw[place:], _U)
        quotients = occupied[np.cumsum(ends) - ends].astype(_U)  # the run that each entry stands in
        return cls(np.vstack([(quotients << _U(BITS - quotient_bits) | remainder)[None], *[x[None] for x in rest]]), counts)


def merge(filters: Iterator[QuotientFilter]) -> QuotientFilter | None:
    """All filters as one; those of like sizes are merged first, so an entry moves a number of times that grows as a logarithm."""
    held: list[QuotientFilter] = []
    for f in filters:
        held.append(f)
        while len(held) > 1 and len(held[-2]) <= 2 * len(held[-1]):
            held[-2:] = [held[-2].merged(held[-1])]
    while len(held) > 1:
        held[-2:] = [held[-2].merged(held[-1])]
    return held[0] if held else None
