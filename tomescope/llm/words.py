"""Words, lines and hashed n-grams of one text (helpers that run inside Arrow batches).

A word is a run of characters other than blank and the five ASCII controls from tab to
carriage return, which is what ``bytes.split`` without an argument cuts UTF-8 text into.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def stable_hashes(words: list[bytes]) -> np.ndarray:
    """One number per word, the same in every process (buckets are made of these)."""
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def strong_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit number per word, the same in every process, for comparing sets of words or shingles."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each tuple of neighbours."""
    with np.errstate(over="ignore"):
        h = parts[0] * M1
        for p in parts[1:]:
            h = (h ^ (h >> np.uint64(29))) * M2 + p * M1
        return (h ^ (h >> np.uint64(32))) * M3


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of all runs of ``n`` neighbours."""
    if len(hashes) < n:
        return hashes[:0]
    return mixed(*(hashes[i : len(hashes) - n + 1 + i] for i in range(n)))


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)
