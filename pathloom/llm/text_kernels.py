"""Vectorised word splitting and hashing over Arrow string columns.

The functions take the bytes of many texts at once, so that no Python object
is made for a word.  Memory follows the slice size or, where it is larger,
one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))

#: The six white-space bytes \x20 \x09-\x0D end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes that aren't part of a letter or digit: all of ASCII but these.
MARKS = np.array([not (b > 127 or chr(b).isalnum()) for b in range(256)])

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Keeps the first 0 ... 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half of the output."""
    h = (h ^ (h >> U64(30))) * _MIX[0]
    h = (h ^ (h >> U64(27))) * _MIX[1]
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of the texts first_row ... of one slice.  ``bounds[i]:bounds[i+1]``
    are the words of text i; starts and ends are byte offsets in ``data``.
    ``blocks`` are the words' bytes in eights, the last filled up with zeros;
    ``n_blocks`` of them are a word."""

    first_row: int
    offsets: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    blocks: np.ndarray
    n_blocks: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of texts; null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def _in_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, number of each within its word, blocks of each word)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each one on
    n_blocks = (ends - starts + 7) >> 3
    owner = np.repeat(np.arange(len(starts)), n_blocks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    at = starts[owner] + 8 * inner
    return eights[at] & _FIRST[np.minimum(ends[owner] - at, 8)], inner, n_blocks


def _hash_blocks(blocks: np.ndarray, inner: np.ndarray, n_blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A word's hash: the sum of its blocks, each mixed with its number, and its
    size, mixed again.  A sum of powers of one base wouldn't do: whatever the
    base, some pairs of words (Thue and Morse's) have the same modulo 2**64."""
    if not len(n_blocks):
        return np.zeros(0, U64)
    mixed = mix(blocks ^ mix((inner + 1).astype(U64) * U64(_BASE)))
    return mix(np.add.reduceat(mixed, np.cumsum(n_blocks) - n_blocks) + sizes.astype(U64) * U64(_BASE))


#: A full stop or comma, and letters of ASCII.
STOP = np.array([chr(b) in ".," for b in range(256)])
LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def words(texts: pa.Array, lower: bool = False, between: np.ndarray = SPACE, stops: bool = False) -> Iterator[Words]:
    """Words (runs of bytes that aren't in ``between``) with a 64-bit hash each.
    With ``stops`` a word doesn't hold one full stop or comma at its end, if a
    letter of ASCII stands before that."""
    for row, offsets, data in slices(texts):
        inside = ~between[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        cuts = offsets[:-1]
        cuts = cuts[cuts < len(data)]
        first = inside.copy()
        first &= ~before[:-1]
        first[cuts] = inside[cuts]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:] - 1
        tails = tails[(tails >= 0) & (offsets[1:] > offsets[:-1])]
        last[tails] = inside[tails]
        ends = np.flatnonzero(last) + 1
        if stops and len(ends):
            ends = ends - (STOP[data[ends - 1]] & (ends - starts > 1) & LETTER[data[ends - 2]])
        blocks, inner, n_blocks = _in_blocks(LOWER[data] if lower else data, starts, ends)
        hashes = _hash_blocks(blocks, inner, n_blocks, ends - starts)
        yield Words(row, offsets, data, starts, ends, np.searchsorted(starts, offsets), hashes, blocks, n_blocks)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k neighbouring words; fewer words give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for i in range(k):
        total = (total + hashes[i : i + n]) * U64(_BASE | 1)
        total ^= total >> U64(29)
    return mix(total)
