"""Words of whole Arrow batches as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case. Hashes have
64 bits: word hashes are polynomials over random byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240131)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _VALUE[LOWER]
_VALUE[IS_SPACE] = 0
_BASE, _INVERSE = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 2**64)
_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    if len(have) <= 1 << 22:  # longer ones serve a single very long text
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset of each row (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their bytes' bounds."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, n)[starts])


def shingle_sets(column, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct hashes in ascending order) for the rows of a text column, in row order.

    A text of fewer than ``width`` words has one shingle, the whole; one without words none.
    """
    data, offsets = utf8(column)
    for first, end in slices(offsets):
        at = offsets[first : end + 1] - offsets[first]
        part = data[offsets[first] : offsets[end]]
        starts, ends, rows = word_bounds(part, at)
        words = span_hashes(part, starts, ends)
        begin = np.searchsorted(rows, np.arange(end - first + 1))
        full = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            full += words[k : len(words) - width + 1 + k] * _FACTORS[k] if len(full) else full
        full = mix(full)
        for i in range(end - first):
            a, b = begin[i], begin[i + 1]
            if b - a >= width:
                yield first + i, np.unique(full[a : b - width + 1])
            elif b > a:
                short = np.append(words[a:b] * _FACTORS[: b - a], _FACTORS[20 + b - a]).sum(dtype=np.uint64)
                yield first + i, mix(np.array([short], np.uint64))
            else:
                yield first + i, np.zeros(0, np.uint64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys; batches are in key order, keys hold no null."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find; the smallest id of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up.setdefault(a, a)
        self.up[b] = a
        return True

    def pairs(self) -> tuple[list[int], list[int]]:
        """Each id that is not a root, and its root."""
        ids = [x for x, p in self.up.items() if p != x]
        return ids, [self.find(x) for x in ids]
