"""Words of many texts at once, on their UTF-8 bytes.

A word is a run of digits, ASCII letters and non-ASCII characters; A-Z count
as a-z.  As every byte of a non-ASCII character is above 0x7F, runs of bytes
are exactly runs of characters.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: 0 for bytes outside words, else the lower-cased byte.
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b) in "0123456789abcdefghijklmnopqrstuvwxyz" or _b >= 0x80:
        _LOWER[_b] = _b
    elif chr(_b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        _LOWER[_b] = _b + 32

_SLAB = 1 << 17
_LONG = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _SLAB + _LONG + 1
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """Words of a list of texts: ``hashes``, byte ranges, and each text's range of words."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        joined = b"\0" + b"\0".join(texts) + b"\0"
        self.chars = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = self.chars != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        starts, ends, out = self.starts, self.ends, np.empty(len(self.starts), np.uint64)
        up, down = _powers()
        i = 0
        while i < len(starts):
            if ends[i] - starts[i] > _LONG:
                out[i] = xxhash.xxh64_intdigest(self.chars[starts[i] : ends[i]].tobytes())
                i += 1
                continue
            j = int(np.searchsorted(ends, starts[i] + _SLAB, side="right"))
            j = max(j, i + 1)
            long = np.flatnonzero(ends[i:j] - starts[i:j] > _LONG)
            if len(long):
                j = i + int(long[0])
            a, b = int(starts[i]), int(ends[j - 1])
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.chars[a:b] * up[: b - a], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
            i = j
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.chars[self.starts[i] : self.ends[i]].tobytes()

    def line(self, i: int, j: int) -> bytes:
        """Words i to j, one space between."""
        return b" ".join(self.word(k) for k in range(i, j))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words (also across texts; callers mask those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[i : n + i]
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's k-word shingles as hashes, and the text's number for each.

    A text of fewer than k words, but not none, is one shingle.
    """
    counts = np.diff(words.bounds)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), per)
    first = np.repeat(words.bounds[:-1], per)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    whole = grams(words.hashes, k)
    out = np.zeros(len(owner), np.uint64)
    at = first + within
    long = np.repeat(counts >= k, per)
    out[long] = whole[at[long]]
    for i in np.flatnonzero(~long):
        text = owner[i]
        part = words.hashes[words.bounds[text] : words.bounds[text + 1]]
        out[i] = grams(part, len(part))[0] ^ np.uint64(len(part))
    return out, owner


def byte_groups(sizes: list[int], most: int) -> list[slice]:
    """Consecutive slices of about ``most`` bytes each, at least one item in each."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            out.append(slice(start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append(slice(start, len(sizes)))
    return out
