"""A minimal perfect hash over 64-bit keys, by levels of collision-free bit arrays.

Level by level the keys still without a place are hashed into an array of ``GAMMA`` cells a
key; keys alone in their cell are placed there, the others go on. A key's number is the rank
of its bit over all levels: n keys get the numbers 0 to n - 1. About three bits a key.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed, so distinct keys part sooner or later."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(ranks - 1 + total)
            total += int(ranks[-1])
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """``keys`` must be distinct."""
        left, levels = keys.astype(np.uint64), []
        while len(left):
            cells = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for a key that meets no bit and so is surely absent."""
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<u8").tobytes()
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", n, 8).astype(int)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            length = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size).astype(bool))
            at += length
        return cls(levels)
