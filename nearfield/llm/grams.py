"""Hashed character n-grams of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def presence(text: str, longest: int, bits: int) -> np.ndarray:
    """2**bits booleans: which buckets the n-grams of 1 to longest code points fall into."""
    seen = np.zeros(1 << bits, bool)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gram = np.zeros(len(codes) + 1, np.uint32)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        gram = (gram[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        gram ^= gram >> np.uint32(15)
        seen[(gram * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)] = True
    return seen
