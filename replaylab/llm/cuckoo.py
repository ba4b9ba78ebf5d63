"""Cuckoo filter over 64-bit hashes: insert, delete, vectorised lookups, and a byte form for a Parquet cell.

Each bucket has four 16-bit marks; a mark sits in one of two buckets, and either follows from the other and the
mark alone, so a mark can be moved or deleted without its key.  There are no false negatives.
"""

from __future__ import annotations

import random

import numpy as np

SLOTS = 4
_KICKS = 500
_LOAD = 0.8


def _scramble(marks: np.ndarray) -> np.ndarray:
    """A spread-out 32-bit number per mark."""
    return ((marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)


def _places(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mark (never 0) and both buckets of each unsigned 64-bit hash."""
    marks = (hashes >> np.uint64(48)).astype(np.uint16)
    marks = np.where(marks == 0, np.uint16(1), marks)
    first = (hashes & np.uint64(n_buckets - 1)).astype(np.int64)
    return marks, first, (first ^ _scramble(marks)) & (n_buckets - 1)


class CuckooFilter:
    def __init__(self, n_buckets: int):
        if n_buckets & (n_buckets - 1):
            raise ValueError("a power of two is needed")
        self.slots = np.zeros((n_buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, hashes: np.ndarray, room_for: int = 0) -> CuckooFilter:
        """A filter of distinct keys' hashes, with room for as many as asked; grows until all fit."""
        n = 1
        while n * SLOTS * _LOAD < max(len(hashes), room_for, 1):
            n *= 2
        while True:
            out = cls(n)
            if all(out.insert(h) for h in hashes.tolist()):
                return out
            n *= 2

    def insert(self, key_hash: int) -> bool:
        """Add one key; False (and no change) if no place is found, then the filter must be rebuilt larger."""
        (mark,), (first,), (second,) = _places(np.array([key_hash], dtype=np.uint64), len(self.slots))
        for bucket in (first, second):
            row = self.slots[bucket]
            for s in range(SLOTS):
                if row[s] == 0:
                    row[s] = mark
                    return True
        undo, at, rnd = [], int(first), random.Random(int(key_hash))
        for _ in range(_KICKS):
            s = rnd.randrange(SLOTS)
            undo.append((at, s, self.slots[at, s]))
            mark, self.slots[at, s] = self.slots[at, s], mark
            at = int((at ^ _scramble(np.array([mark]))[0]) & (len(self.slots) - 1))
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        for bucket, s, old in reversed(undo):
            self.slots[bucket, s] = old
        return False

    def delete(self, key_hash: int) -> bool:
        """Remove one key that was inserted."""
        (mark,), (first,), (second,) = _places(np.array([key_hash], dtype=np.uint64), len(self.slots))
        for bucket in (first, second):
            held = np.flatnonzero(self.slots[bucket] == mark)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        marks, first, second = _places(hashes.astype(np.uint64, copy=False), len(self.slots))
        return ((self.slots[first] == marks[:, None]) | (self.slots[second] == marks[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        out = cls(1)
        out.slots = np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return out
