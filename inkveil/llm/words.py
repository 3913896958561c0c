"""Words of many texts at once, from their bytes: runs of anything but the space and 0x09-0x0D."""

from __future__ import annotations

import numpy as np

from inkveil.llm.common import mix

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A random 64-bit number for each byte value at each of 64 places; a word's hash sums those of its bytes.
_OF_BYTE = mix(np.arange(64 * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def find_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word; offsets cut the bytes into texts."""
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]  # the first byte of a text begins a word whatever stands before it
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (equal words have equal hashes; the reverse holds but for chance)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    raw = data[place + np.repeat(start, size)].astype(np.int64)
    return mix(np.add.reduceat(_OF_BYTE[((place & 63) << 8) | raw] + (place >> 6).astype(np.uint64) * raw.astype(np.uint64), first) + size.astype(np.uint64))


def hash_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive hashes; runs may cross texts, which the caller masks out."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + count])
    return out
