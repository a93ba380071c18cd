"""Vectorised text helpers shared by the corpus operators.

Everything here works on whole Arrow string columns at once: the UTF-8
buffer is viewed as one ``uint8`` array, so no Python loop ever touches a
character.  Text is handled in slices of bounded size (``SLICE_BYTES``) so a
worker's memory does not depend on the size of an Arrow batch; a single
document longer than the bound forms a slice of its own and is still
processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("0"):ord("9") + 1] = True
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[0x80:] = True

_BYTE_MIX = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class _Cache(dict):
    """Kept by each worker for itself: it is empty again wherever it is sent."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) base and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = -(-n // (1 << 20)) << 20
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer (splitmix64) over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    elif pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding at most ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a column: ``start``/``end`` byte spans, ``doc`` row and 64-bit ``hash``.

    A word is a maximal run of ASCII letters and digits or bytes from 0x80 up.
    ``count`` holds the number of words of each row.
    """

    def __init__(self, col: pa.Array, lower: bool = True):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        self.raw, self.offsets = raw, offsets = utf8(pc.utf8_lower(col) if lower else col)
        self.rows = len(offsets) - 1
        n = len(raw)
        letter = _LETTER[raw]
        ahead = np.zeros(n + 1, dtype=bool)
        ahead[1:] = letter
        ahead[offsets[:-1]] = False  # a document's first byte never continues a word
        self.start = start = np.flatnonzero(letter & ~ahead[:-1])
        ahead = np.zeros(n + 1, dtype=bool)
        ahead[:n] = letter
        ahead[offsets] = False
        self.end = end = np.flatnonzero(letter & ~ahead[1:]) + 1
        self.count = np.diff(np.searchsorted(start, offsets))
        self.doc = np.repeat(np.arange(self.rows), self.count)
        up, down = _powers(n + 1)
        self.prefix = total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_MIX[raw] * up[:n], out=total[1:])
        self.hash = self.spans(start, end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
        _, down = _powers(len(self.prefix))
        return mix64((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(np.uint64))
