"""Vectorised passes over the UTF-8 bytes of many texts at once, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about so many bytes; a longer text makes a run of its own.
SLICE_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LESS = np.uint64(0xBF58476D1CE4E5B9)
_MORE = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _LESS
    x ^= x >> np.uint64(27)
    x *= _MORE
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each text begins (and the last ends). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes in all, or of one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross the texts' borders: starts, ends, and the text of each."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    before[borders] = False
    after[borders - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(_BASE_INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least `size` of each."""
    for usual in (SLICE_BYTES, 4 * SLICE_BYTES):
        if size <= usual + 1024:
            return _powers(usual + 1024)
    return _powers(1 << int(size).bit_length())


class Hasher:
    """64-bit hashes of any spans of one buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        codes = _BYTE_CODE[data]
        codes *= up[:n]
        np.cumsum(codes, dtype=np.uint64, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) * _ODD))


    def windows(self, k: int) -> np.ndarray:
        """Of each k bytes in a row."""
        raw = self._sums[k:] - self._sums[:-k]
        raw *= self._down[: len(raw)]
        raw ^= np.uint64(k * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
        return mix(raw)


def hash_texts(texts: list[bytes]) -> np.ndarray:
    """The same hashes as Hasher gives, of whole byte strings."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.empty(0, np.int64)
    return Hasher(joined).of(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if texts else np.empty(0, np.uint64)


def hash_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive values; width - 1 fewer than there are values."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + hashes[k : k + len(out)]
    return mix(out)


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes a character class matches, as a table of 256 truth values."""
    import re

    test = re.compile(pattern.encode("latin-1"), re.DOTALL)
    return np.array([bool(test.fullmatch(bytes([b]))) for b in range(256)])
