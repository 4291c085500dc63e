"""Words of a text and hashes of runs of them, as numpy arrays.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker keeps; beyond, it starts anew.
CACHE = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, at, width, cur, left = None, 0, 1, h, k
    while left:
        if left & 1:
            part = cur[at : at + n]
            out = part + np.uint64(k) if out is None else mixed(out, part)
            at += width
        left >>= 1
        if left:
            cur = mixed(cur[:-width], cur[width:])
            width *= 2
    return out
