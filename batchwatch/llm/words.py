"""Words and hashed word shingles of whole texts, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z on UTF-8 bytes; every other character is left alone
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: one odd factor per place of a shingle, drawn once from a fixed generator
_FACTORS = np.random.default_rng(8).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly those bytes."""
    return utf8(text).translate(ASCII_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """np.unique without its overhead for short arrays."""
    values = np.sort(values)
    first = np.empty(len(values), bool)
    first[:1] = True
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles.

    A shorter text is one shingle, a text without words has none.  The number of words is part of the
    hash, so a short text never equals a full shingle.
    """
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)
    taken = min(width, len(words))
    n = len(words) - taken + 1
    out = np.full(n, taken, np.uint64)
    for k in range(taken):
        out += hashed[k:n + k] * _FACTORS[k]
    return sorted_distinct(mix(out))
