"""Vectorised helpers over the bytes of many texts at once.

A batch is a byte array with the texts one after the other and their offsets.
All hashes are 64-bit polynomials over the bytes (or word hashes) of a span,
taken from prefix sums modulo 2**64 and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C55 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``most`` bytes.

    Gives the first row, the bytes and the offsets of each run; a null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        end = min(end, len(column))
        yield start, raw[off[start]:off[end]], off[start:end + 1] - off[start]
        start = end


class Words:
    """Words of the texts of a run: byte spans, and for each text its first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        word = ~WHITE[data]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        before[inner] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, off)  # of each text, and the total
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a text, the text of each, and its first word."""
        count = np.maximum(self.count - n + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + self.first[:-1][text]
        up, _ = powers(n + 1)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h += hashes[at + j] * up[j + 1]
        return mix(h), text, at

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        size = self.end - self.start
        begin = np.cumsum(size + 1) - (size + 1)
        line = np.full(int((size + 1).sum()), 32, np.uint8)
        from_ = np.arange(int(size.sum())) + np.repeat(self.start - (np.cumsum(size) - size), size)
        line[from_ + np.repeat(begin - self.start, size)] = self.data[from_]
        return line, begin, begin + size


def parts(size: np.ndarray, most: int = 1 << 22) -> Iterator[slice]:
    """Slices of the items whose sizes add up to about ``most``."""
    total, low = np.concatenate([[0], np.cumsum(size)]), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, side="right")) - 1)
        yield slice(low, high)
        low = high


def spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The strings at the given byte spans."""
    size = hi - lo
    off = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.arange(off[-1]) + np.repeat(lo - off[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Lookup:
    """An array hash table from distinct 64-bit keys to values; absent keys give ``missing``. The arrays given are not copied."""

    PIECE = 1 << 18  # keys worked on at once

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing=0):
        self.bits = max(4, (2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        self.keys, self.values, self.missing = keys.astype(np.uint64, copy=False), values, missing
        for low in range(0, len(keys), self.PIECE):
            some = self.keys[low:low + self.PIECE]
            left, at = np.arange(low, low + len(some), dtype=np.int32), self.place(some)
            while len(left):
                free = self.slot[at] < 0
                self.slot[at[free]] = left[free]  # of several keys for one place the last one stays
                lost = self.slot[at] != left
                left, at = left[lost], (at[lost] + 1) & (size - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.missing, self.values.dtype)
        if not len(self.keys):
            return out
        for low in range(0, len(keys), self.PIECE):
            some, to = keys[low:low + self.PIECE], out[low:low + self.PIECE]
            at = self.place(some)
            found = self.slot[at]
            hit = (found >= 0) & (self.keys[found] == some)
            to[hit] = self.values[found[hit]]
            left = np.flatnonzero(~hit & (found >= 0))
            while len(left):
                at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
                found = self.slot[at[left]]
                hit = (found >= 0) & (self.keys[found] == some[left])
                to[left[hit]] = self.values[found[hit]]
                left = left[~hit & (found >= 0)]
        return out


def byte_grams(data: np.ndarray, off: np.ndarray, n: int, begin: int = 0xFE, end: int = 0xFF) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``n`` bytes that end at each byte of each text, packed with the last byte lowest, and where each text's begin.

    A text is preceded by ``n - 1`` bytes ``begin`` and followed by one ``end``; neither occurs in UTF-8.
    """
    size = np.diff(off)
    at = off[:-1] + np.arange(len(size)) * n
    padded = np.full(len(data) + n * len(size), begin, np.uint64)
    text = np.repeat(np.arange(len(size)), size)
    padded[np.arange(len(data)) + n * text + n - 1] = data
    padded[at + n - 1 + size] = end
    packed = np.zeros(len(padded), np.uint64)
    for k in range(n):
        packed[k:] |= padded[:len(padded) - k] << np.uint64(8 * k)
    keep = np.ones(len(padded), bool)
    for k in range(n - 1):
        keep[at + k] = False
    return packed[keep], off + np.arange(len(off))


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``first`` has where each text's begin, and the total."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
