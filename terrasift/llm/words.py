"""Words, word hashes and shingles of whole texts, in NumPy, for tasks that receive Arrow batches.

A text is cut at separator bytes. Every separator is ASCII, so cutting the UTF-8 bytes gives the same words as
cutting the code points. Hashes are 64 bit and equal on every machine; they are made from fixed constants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a task works on, so that a task's memory does not follow its batch.
CHUNK_BYTES = 2 << 20


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: True where a byte belongs to a word.
NOT_SPACE = _separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20250101)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """base ** i and base ** -i modulo 2 ** 64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b)))) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """The words of some texts. start, end: bytes in data; first[i]:first[i + 1] are the words of text i.

    kinds has a number for each byte: 0 for separators; neighbours of one other kind make a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, lower: bool) -> None:
        self.offsets, n = offsets, len(data)
        self.sums: np.ndarray | None = None
        self.data = _LOWER[data] if lower else data
        self.kind = kinds[self.data]
        inside = self.kind != 0
        begins, ends = inside.copy(), inside.copy()
        change = self.kind[1:] != self.kind[:-1]
        begins[1:] &= change
        ends[:-1] &= change
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return self.hashes_to(self.start, self.end)

    def hashes_to(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end."""
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        up, down = _POWERS.upto(len(self.data) + 1)
        if self.sums is None:
            self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], out=self.sums[1:])
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width neighbours in hashes; runs may cross texts, which the caller sorts out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        total *= _STEP
        total += hashes[j : j + n]
    return mix(total)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the distinct shingles of text i, ascending, are values[first[i]:first[i + 1]].

    A text of fewer words than width, but not none, has its whole sequence as its one shingle.
    """
    hashes, counts = words.hashes(), words.counts
    windows = window_hashes(hashes, width)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(sizes)))
    value = np.empty(first[-1], dtype=np.uint64)
    for i in np.flatnonzero(counts):
        at, own = words.first[i], value[first[i] : first[i + 1]]
        own[:] = windows[at : at + len(own)] if counts[i] >= width else window_hashes(hashes[at : at + counts[i]], int(counts[i]))
        own.sort()
    own = np.repeat(np.arange(len(counts)), sizes)
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return value[keep], np.searchsorted(own[keep], np.arange(len(counts) + 1))


def distinct_by_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the distinct values of row i, ascending, are values[first[i]:first[i + 1]]."""
    order = np.argsort(row, kind="stable")
    value, row = value[order], row[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(first[:-1], first[1:], strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.searchsorted(row[keep], np.arange(rows + 1))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of stretches of a text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK_BYTES, side="right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
