"""A cuckoo filter over 64-bit hashes in numpy, with insertion, deletion and bulk look-up."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; each hash has two buckets, either of which can be told from the other.

    The number of buckets is a power of two and doubles when an insertion fails, from the hashes that the owner holds.
    """

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.9 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.spin = 0

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = hashes.astype(np.uint64)
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = hashes & np.uint64(self.mask)
        return prints, first, first ^ self._hop(prints)

    def _hop(self, prints: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((prints.astype(np.uint64) * _MIX) >> np.uint64(20)) & np.uint64(self.mask)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether it may have been inserted; never wrong about one that was."""
        prints, a, b = self._places(hashes)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if one found no place: then the filter must be rebuilt larger."""
        for p, a, b in zip(*(x.tolist() for x in self._places(hashes))):
            if not self._put(p, a, b):
                return False
        return True

    def _put(self, p: int, a: int, b: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        at = b
        for _ in range(KICKS):
            self.spin = (self.spin + 1) % SLOTS
            p, self.table[at, self.spin] = int(self.table[at, self.spin]), p
            at ^= int(self._hop(np.array([p], dtype=np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one fingerprint for each hash; only hashes that were inserted may be deleted."""
        for p, a, b in zip(*(x.tolist() for x in self._places(hashes))):
            for at in (a, b):
                own = np.flatnonzero(self.table[at] == p)
                if len(own):
                    self.table[at, own[0]] = 0
                    break

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        capacity = max(4, len(hashes))
        while True:
            made = cls(capacity)
            if made.insert(hashes):
                return made
            capacity = len(made.table) * SLOTS * 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return made
