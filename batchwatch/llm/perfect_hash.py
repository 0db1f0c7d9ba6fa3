"""Minimal perfect hashes of term sets, with the terms stored for verification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from .words import mix

#: places per key that is still without one, on each level
SPACE = 1.5
_LEVELS = 64


def digests(terms: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each term as two arrays."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), np.uint64)
    return both[::2], both[1::2]


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct terms, each term in a slot of its own.

    On a level every key without a slot marks one place; places marked by one key alone give their key a slot,
    numbered by the marks before them, and the other keys go on to the next level.  ``slots`` compares a
    candidate with the term stored in its slot, so a term outside the set never counts.
    """

    def __init__(self, terms: Sequence[bytes]):
        a, b = digests(terms)
        open_keys = np.arange(len(terms))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        slot_of = np.empty(len(terms), np.int64)
        before = 0
        while len(open_keys):
            if len(self.levels) == _LEVELS:
                raise ValueError("terms are not distinct")
            size = max(64, int(SPACE * len(open_keys)))
            place = self._places(a[open_keys], b[open_keys], len(self.levels), size)
            alone = np.bincount(place, minlength=-(-size // 64) * 64) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]])
            settled = alone[place]
            slot_of[open_keys[settled]] = self._rank(bits, ranks, place[settled])
            self.levels.append((size, bits, ranks))
            before += int(settled.sum())
            open_keys = open_keys[~settled]
        stored: list[bytes] = [b""] * len(terms)
        for term, slot in zip(terms, slot_of.tolist()):
            stored[slot] = term
        self.ends = np.cumsum([len(t) for t in stored], dtype=np.int64)
        self.stored = b"".join(stored)

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + np.uint64(level) * b) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = bits[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
        return ranks[word] + np.bitwise_count(below)

    def __len__(self) -> int:
        return len(self.ends)

    def term(self, slot: int) -> bytes:
        return self.stored[self.ends[slot - 1] if slot else 0:self.ends[slot]]

    def slots(self, terms: Sequence[bytes]) -> np.ndarray:
        """The slot of each term, -1 for terms outside the set."""
        out = np.full(len(terms), -1, np.int64)
        a, b = digests(terms)
        left = np.arange(len(terms))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            place = self._places(a[left], b[left], level, size)
            hit = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(bits, ranks, place[hit])
            left = left[~hit]
        some = np.flatnonzero(out >= 0)
        same = [self.term(s) == terms[k] for k, s in zip(some.tolist(), out[some].tolist())]
        out[some[~np.array(same, bool)]] = -1
        return out
