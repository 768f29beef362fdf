"""Words, word hashes and window hashes of whole batches of texts, by numpy over the UTF-8 bytes.

A word is a run of bytes that are not ASCII white space (0x20, 0x09-0x0D). All hashes are 64 bits wide: a
polynomial over the bytes (or over the words of a window) modulo 2**64, then a finalizer.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def released() -> None:
    """Gives freed memory of a long-lived worker back to the system, so that stages don't add up in it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 20), base & (2**64 - 1), dtype=_U)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the len + 1 offsets of its rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    lo, hi = offs[0], offs[-1]
    return (np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)), offs - lo


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows that hold about `most` bytes each; one row alone may hold more."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """hashes, start and end byte of each word; first[d]:first[d + 1] are the words of row d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        n = len(data)
        space = _SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = True
            before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = True
            after[:-1] = space[1:]
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = np.empty(len(self.starts), dtype=_U)
        for a, b in slices(offsets):  # sums over bytes take eight times their room
            lo, hi, own = offsets[a], offsets[b], slice(self.first[a], self.first[b])
            part = _FOLD[data[lo:hi]] if fold else data[lo:hi]
            sums = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum((part.astype(_U) + _U(1)) * _power(_BASE, hi - lo), out=sums[1:])
            starts = self.starts[own] - lo
            self.hashes[own] = mix((sums[self.ends[own] - lo] - sums[starts]) * _power(_BASE_INV, hi - lo + 1)[starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, size: int, step: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `size` words from each word on, and whether they all belong to its row. Other odd steps give other hashes."""
        h, n = self.hashes, len(self.hashes)
        out = np.zeros(n, dtype=_U)
        for k in range(size):
            if k < n:
                out[: n - k] += h[k:] * _U(pow(step, k, 1 << 64))
        last = np.repeat(self.first[1:], self.counts())
        return mix(out + _U(size)), np.arange(n) + size <= last

    def sequences(self) -> np.ndarray:
        """Hash of all words of each row."""
        n = len(self.hashes)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(self.hashes * _power(_BASE, n), out=sums[1:])
        a, b = self.first[:-1], self.first[1:]
        return mix((sums[b] - sums[a]) * _power(_BASE_INV, n + 1)[a] + (b - a).astype(_U))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every word shingle; rows of fewer words have one of all their words, empty rows none."""
        row, (h, ok) = self.rows(), self.windows(size)
        rows, hashes = [row[ok]], [h[ok]]
        counts = self.counts()
        for k in range(1, size):
            short = np.flatnonzero(counts == k)
            if len(short):
                rows.append(short)
                hashes.append(self.windows(k)[0][self.first[short]])
        return np.concatenate(rows), np.concatenate(hashes)
