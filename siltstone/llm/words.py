"""Words of UTF-8 texts as byte ranges with 64-bit hashes, for whole Arrow batches at once.

A word is a maximal run of bytes other than space and 0x09-0x0D. There are two kinds of hash:

* ``word_hashes`` stand for the words themselves: BLAKE2b of each distinct word of a slice under a
  key that is drawn for each run (``new_key``), so that no text can be made to collide;
* ``range_hashes`` only find candidates whose bytes are then compared. A range's hash starts from its
  length and takes in eight bytes at a time, scrambled after each step; ranges of over ``LANES`` steps
  are hashed by BLAKE2b. Its steps can be run backwards: equal hashes prove nothing.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Steps of eight bytes that are taken for a whole batch at once.
LANES = 20
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: What of eight bytes lies within the first k.
_WITHIN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(first * np.uint64(0x8EBC6AF09C88C6E3) + (second ^ np.uint64(0x589965CC75374CC3)))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array, and the n+1 bounds of its values; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(arr: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pairs of about ``most`` bytes each; a longer text stands alone."""
    _, bounds = raw(arr)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, arr.slice(at, to - at)
        at = to


def blocks(arr: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array, bool]]:
    """(first row, slice, whether its last text goes on in the next) of about ``most`` bytes each.

    A longer text is cut before single spaces between two words, so that its words and the pieces
    that a tokenizer splits it into are those of its blocks in a row.
    """
    for at, part in slices(arr, most):
        data, _ = raw(part)
        if len(part) > 1 or len(data) <= most:
            yield at, part, False
            continue
        start = 0
        while len(data) - start > most:
            to = _cut_near(data, start + most)
            if to <= start or to >= len(data):
                break
            yield at, pa.array([data[start:to].tobytes()], pa.binary()), True
            start = to
        yield at, pa.array([data[start:].tobytes()], pa.binary()), False


def _cut_near(data: np.ndarray, at: int, step: int = 1 << 16) -> int:
    """The first place from ``at`` on where a single space stands between two ASCII letters or digits."""
    while at < len(data):
        part = data[at - 1 : at + step + 1]
        plain = (part >= 0x30) & (part < 0x80) & _IS_WORD[part]
        hit = np.flatnonzero((part[1:-1] == 0x20) & plain[:-2] & plain[2:])
        if len(hit):
            return at + int(hit[0])
        at += step
    return len(data)


def lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one little-endian number; beyond the end there are zeros."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    eight = lanes(data)
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    on = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for k in range(LANES):
        if not len(on):
            break
        left = size[on] - 8 * k
        v = eight[starts[on] + 8 * k] & _WITHIN[np.minimum(left, 8)]
        h[on] = joined(h[on], v)
        on = on[left > 8]
    for i in np.flatnonzero(size > 8 * LANES):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def new_key() -> bytes:
    """A key for ``word_hashes``; the driver draws one for each run and hands it to all tasks."""
    return secrets.token_bytes(16)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """Keyed BLAKE2b (64 bits) of byte ranges in order that do not overlap; each distinct one is hashed once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    body = data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    coded = words.dictionary_encode()
    known = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8, key=key).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()]


def same_ranges(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges of two byte arrays hold the same bytes, pairwise; ``size`` holds for both."""
    out = np.ones(len(size), bool)
    left, right = lanes(a), lanes(b)
    on = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for k in range(LANES):
        if not len(on):
            break
        rest = size[on] - 8 * k
        same = (left[a_starts[on] + 8 * k] ^ right[b_starts[on] + 8 * k]) & _WITHIN[np.minimum(rest, 8)] == 0
        out[on[~same]] = False
        on = on[same & (rest > 8)]
    for i in np.flatnonzero(size > 8 * LANES):
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + size[i]], b[b_starts[i] : b_starts[i] + size[i]])
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other byte changes."""
    return _LOWER[data]


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n+1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = _IS_WORD[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    start[first] |= inside[first]
    end[last] |= inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)
