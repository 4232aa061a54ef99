"""Words and their hashes straight from the bytes of an Arrow string column.

A word is a maximal run of bytes other than space and 0x09 to 0x0D; A-Z count as a-z.
Hashes have 64 bits: a polynomial over fixed random values of the bytes, then a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def bounded(run):
    """The function of batches, made to give a worker's unused memory back when its task ends: workers live on."""

    def runs(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return runs


def released() -> None:
    """Gives memory that is not in use back to the system."""
    import ctypes
    import gc

    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it decides by itself
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))[LOWER]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            more = min(filled, size - filled)
            np.multiply(have[:more], U(pow(base, filled, 1 << 64)), out=have[filled : filled + more])
            filled += more
        _POWERS[base] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(raw: np.ndarray, at: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about so many bytes: first, end, their bytes, their offsets."""
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


class Words:
    """starts, ends: of each word in the bytes; bounds: n + 1 offsets of the texts among the words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        n = len(raw)
        full = ~SPACE[raw]
        begins, stops = full.copy(), full.copy()
        if n:
            begins[1:] &= ~full[:-1]
            stops[:-1] &= ~full[1:]
            inner = at[:-1][at[:-1] < n]
            begins[inner] = full[inner]
            last = at[1:][at[1:] > 0] - 1
            stops[last] = full[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, at)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[self.raw] * _powers(_BASE, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _powers(_INVERSE, n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * U(0xA0761D6478BD642F))

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of several columns of hashes, in their order."""
    h = mix(columns[0] + U(len(columns)))
    for c in columns[1:]:
        h = mix(h * U(0x9E3779B97F4A7C15) ^ c)
    return h


def crc_remainder(ids: list, m: int) -> np.ndarray:
    """crc32 of each id as text, modulo m; null counts as empty text."""
    from zlib import crc32

    return np.fromiter((crc32(b"" if i is None else str(i).encode()) % m for i in ids), dtype=np.int64, count=len(ids))
