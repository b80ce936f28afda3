"""Vectorised reading of Arrow text columns: raw UTF-8, words, 64-bit word hashes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z
lower-cased. Words are compared by a 64-bit hash: a polynomial over random
per-byte constants modulo 2**64, finished with a splitmix round, so among a
billion distinct words about 0.03 pairs are expected to collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_BYTE = _BYTE[LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls up to 4 MiB of text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = base
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the rows' offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text worked on at a time.
BLOCK = 1 << 18


def _cut(data: np.ndarray, at: int) -> int:
    """Where a block that begins at ``at`` ends: after white space, so that no word is cut."""
    end = at + BLOCK
    if end >= len(data):
        return len(data)
    back = np.flatnonzero(SPACE[data[at:end]])
    if len(back):
        return at + int(back[-1]) + 1
    while end < len(data):
        ahead = np.flatnonzero(SPACE[data[end : end + BLOCK]])
        if len(ahead):
            return end + int(ahead[0]) + 1
        end += BLOCK
    return len(data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and each row's offsets into them (rows + 1)."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = _cut(data, at)
        inner = np.clip(offsets, at, end) - at
        found, start = _words(data[at:end], inner)
        hashes.append(found)
        starts.append(start + at)
        at = end
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, offsets)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a block."""
    n = len(data)
    solid = ~SPACE[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], last[-1] = True, True
    np.logical_not(solid[:-1], out=first[1:])
    np.logical_not(solid[1:], out=last[:-1])
    first[offsets[:-1][offsets[:-1] < n]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    start, end = np.flatnonzero(solid & first), np.flatnonzero(solid & last)
    value = _LOWER_BYTE[data] * _power(_BASE, n)
    total = np.cumsum(value)
    # The sum over a word, shifted back to the start of the block.
    own = (total[end] - total[start] + value[start]) * _power(_BASE_INVERSE, n)[start]
    return mix(own + (end - start + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive hashes (order counts)."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    count = len(hashes) - size + 1
    found = np.zeros(count, np.uint64)
    for i in range(size):
        found = found * np.uint64(_BASE) + hashes[i : i + count]
    return mix(found)
