"""Words and word sequences of Arrow text columns as 64-bit hashes, computed over whole blocks with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` yields.
A word hash is a polynomial over random byte codes; a sequence hash is a polynomial over word hashes.
Both are finished with a bijective mixer, so two unequal sequences agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & _M, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Tables for hashing; one is made for each task."""

    def __init__(self, lower: bool):
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        if lower:
            codes[65:91] = codes[97:123]
        self.codes = codes
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.n = 0
        self._grow(BLOCK + 1)

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            self.pow = powers(_BASE, n)
            self.inv = powers(pow(_BASE, -1, 1 << 64), n)

    def block(self, b: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a run of documents, and the number of the first word of each."""
        n = len(b)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(doc_starts), np.int64)
        self._grow(n + 1)
        word = ~self.space[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = doc_starts[doc_starts < n]
        first[at] = word[at]
        last = word.copy()
        last[:-1] &= ~word[1:]
        before = at[at > 0] - 1
        last[before] = word[before]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[b] * self.pow[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inv[starts]), np.searchsorted(starts, doc_starts)

    def long_document(self, b: np.ndarray) -> np.ndarray:
        """Word hashes of one document, block by block, cut at white space."""
        parts, at, zero = [], 0, np.zeros(1, np.int64)
        while at < len(b):
            end = min(at + BLOCK, len(b))
            if end < len(b):
                gaps = np.flatnonzero(self.space[b[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    while end < len(b) and not self.space[b[end]]:
                        end += 1
            parts.append(self.block(b[at:end], zero)[0])
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def documents(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, word hashes of rows lo to hi, word offsets of these rows) for an Arrow string column; null is empty."""
        data, offsets = text_buffer(column)
        lo, rows = 0, len(column)
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, side="right")) - 1)
            b = data[offsets[lo] : offsets[hi]]
            if len(b) > BLOCK:
                h = self.long_document(b)
                yield lo, hi, h, np.array([0, len(h)], np.int64)
            else:
                h, at = self.block(b, (offsets[lo:hi] - offsets[lo]).astype(np.int64))
                yield lo, hi, h, np.append(at, len(h))
            lo = hi


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows, without a copy where it has no nulls."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at.astype(np.int64)


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; run i starts at word i. Lengths are told apart by k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 8:
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * np.uint64(_STEP) + h[j : j + n]
        return mix(out)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_STEP, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(pow(_STEP, -1, 1 << 64), n) + np.uint64(k))


def whole(h: np.ndarray) -> np.uint64:
    """Hash of one whole sequence of fewer words than a shingle has; equals ``sequences(h, len(h))[0]``."""
    return sequences(h, len(h))[0]
