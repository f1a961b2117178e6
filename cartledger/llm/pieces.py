"""Vectorised looks at the bytes of many texts at once, for use inside Arrow batches.

A *piece* is a run of whole texts of one batch as a single byte array.  Work
arrays are a small multiple of a piece, so memory follows ``PIECE_BYTES`` or, if
that is longer, one text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SMALL_PIECE = 1 << 18  # where work arrays are a large multiple of a piece
_WIDE_WORD = 256  # longer words are hashed one at a time

# The white space of all contracts (blank and U+0009 to U+000D).
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Freed memory to the system after each batch: workers outlive their stage."""
    _trim()(0)


def texts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the bounds of each text; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


@dataclass
class Piece:
    data: np.ndarray  # uint8
    bounds: np.ndarray  # n + 1 offsets into data

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def pieces(array: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Whole texts in pieces of about ``limit`` bytes; a longer text is a piece of its own."""
    data, offsets = texts_of(array)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Piece(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    give_back()


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of marked bytes; runs end where a text does."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (n + 1 values)."""
    starts, ends = spans(~SPACES[piece.data], piece.bounds)
    return starts, ends, np.searchsorted(starts, piece.bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a step."""
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    wide = lengths > _WIDE_WORD
    active = np.flatnonzero(~wide & (lengths > 0))
    step = 0
    while len(active):
        left = lengths[active] - step
        chunk = eights[starts[active] + step]
        cut = left < 8
        keep = np.where(cut, left, 0).astype(np.uint64) * np.uint64(8)
        chunk = np.where(cut, chunk & ((np.uint64(1) << keep) - np.uint64(1)), chunk)
        out[active] = mixed((out[active] ^ chunk) * np.uint64(0x9E3779B97F4A7C15))
        active = active[left > 8]
        step += 8
    for i in np.flatnonzero(wide):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def windows(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words that lies in one text, and its first word's index."""
    if len(codes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(codes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + codes[k : k + n])
    text = np.searchsorted(first, np.arange(len(codes)), "right")
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return out[at], at


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each pair of bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
