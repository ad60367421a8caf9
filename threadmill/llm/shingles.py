"""Vectorised word and shingle hashing over whole texts (numpy, byte level)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240611)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random value for each byte; A-Z share those of a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
#: Longer words are hashed one by one.
LONG_WORD = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(LONG_WORD, _STEP)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 2 << 20):
    """(a, b) ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, hash) of every word, A-Z as a-z; words are runs without white space within one text."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    a = int(start[0])
    place = np.arange(n - a)
    place -= np.repeat(start - a, np.diff(np.append(start, n)))
    value = _BYTE[data[a:]]
    value *= _POWERS[np.minimum(place, LONG_WORD)]
    value *= inside[a:]
    h = np.add.reduceat(value, start - a)
    size = end - start
    h += size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(bytes(data[start[i] : end[i]]).lower(), digest_size=8).digest(), "little")
    return start, end, text, mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``k`` words; fewer words are one shingle, none is the empty set."""
    n = len(offsets) - 1
    _, _, text, h = words(data, offsets)
    count = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled *= np.uint64(0x9FB21C651E98DF25)
        rolled += mix(h[j : j + len(rolled)] ^ np.uint64(j + 1))
    rolled = mix(rolled)
    out = []
    for i in range(n):
        a, m = int(first[i]), int(count[i])
        if m >= k:
            s = np.sort(rolled[a : a + m - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif m:
            x = np.array([m], np.uint64)
            for j in range(a, a + m):
                x = mix(x * np.uint64(0xA24BAED4963EE407) ^ h[j : j + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out
