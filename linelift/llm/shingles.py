"""Word and n-gram hashes of whole texts, computed on the bytes of a text at once."""

from __future__ import annotations

import numpy as np
import xxhash

SEGMENT = 1 << 20
"""Bytes hashed at a time; a longer word is hashed on its own."""

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(31)
_SPACE = np.zeros(256, np.int8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: A-Z in lower case, split at
    ``[\\x20\\x09-\\x0D]``. A word's bytes are the digits of a number to an odd base modulo
    2 ** 64, found for all words by one running sum, and then mixed."""
    data = data.lower()
    b = np.frombuffer(data, np.uint8)
    word = np.ones(len(b) + 2, np.int8)
    word[1:-1] = _SPACE[b]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(ends, first + SEGMENT, side="right"))
        if j == i:
            out[i] = xxhash.xxh3_64_intdigest(data[first:ends[i]])
            i += 1
            continue
        part = b[first:ends[j - 1]]
        up, down = _powers.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    out ^= out >> np.uint64(32)
    out *= _MIX[1]
    out ^= out >> np.uint64(29)
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; none if there are fewer."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out += hashes[j:j + len(out)]
        out *= _MIX[j % len(_MIX)]
        out ^= out >> _SHIFT
    return out


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; with fewer words, the whole
    sequence as one; none without words."""
    words = word_hashes(data)
    if len(words) < k:
        # one shingle, told apart from longer ones by its number of words
        return ngram_hashes(words, len(words)) ^ np.uint64(len(words)) if len(words) else words
    out = ngram_hashes(words, k)
    out.sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]
