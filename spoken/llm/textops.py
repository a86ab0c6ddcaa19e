"""Vectorised word and shingle hashing over Arrow string buffers.

Every function works on whole batches of UTF-8 bytes with numpy, so that no Python object is made per word. Words are runs
of bytes other than 0x20 and 0x09-0x0D, which splits UTF-8 text exactly as the code-point class ``[^\\x20\\x09-\\x0D]+`` does.
Nulls count as empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (fixed public constants): a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        have = _pow_cache[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0, nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1, offset=8 * at) if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8, count=hi - lo, offset=lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def release() -> None:
    """Gives freed memory back to the system: Spark keeps its Python workers, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``limit`` bytes of text, or one longer row: bounded memory at any row size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            to = min(to, batch.num_rows, at + rows)
            yield batch.slice(at, to - at)
            at = to
        del batch
    _pow_cache.clear()
    release()


class Words:
    """Words of a batch: byte spans, the row of each, and the first word of each row (``first`` has one more entry)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        n = len(raw)
        self.raw = _LOWER[raw] if lower else raw
        self.rows = len(offsets) - 1
        word = ~space[self.raw]
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            before[offsets[:-1][offsets[:-1] < n]] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            after[ends] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal bytes wherever they stand."""
        return self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span."""
        n = len(self.raw)
        if getattr(self, "_sums", None) is None:
            self._sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(_BYTE[self.raw] * powers(_P, n), dtype=U64, out=self._sums[1:])
        out = self._sums[end] - self._sums[start]
        out *= powers(_PINV, n + 1)[start]
        out += (end - start).astype(U64)
        return mix(out)

    def total(self, flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum of a per-byte flag in each row."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``size`` words within a row."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n - size + 1, dtype=U64)
    for k in range(size):
        total = total * U64(0x9FB21C651E98DF25) + hashes[k : n - size + 1 + k]
    ok = np.ones(n - size + 1, dtype=bool)
    for back in range(1, size):  # a window must not cross into the next row
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(total[at]), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row bounds). Words are lower-cased A-Z; a row with fewer words has its whole sequence
    as one shingle, a row without words the empty set."""
    w = Words(raw, offsets, lower=True)
    h = w.hashes()
    win, at = windows(h, w.first, size)
    row = w.row[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for k in range(size - 1):
            has = w.counts[short] > k
            extra[has] = extra[has] * U64(0xD6E8FEB86659FD93) + h[w.first[short[has]] + k]
        win = np.concatenate([win, mix(extra + w.counts[short].astype(U64))])
        row = np.concatenate([row, short])
    order = np.lexsort((win, row))
    win, row = win[order], row[order]
    if len(win):
        keep = np.ones(len(win), dtype=bool)
        keep[1:] = (win[1:] != win[:-1]) | (row[1:] != row[:-1])
        win, row = win[keep], row[keep]
    return win, np.searchsorted(row, np.arange(w.rows + 1))
