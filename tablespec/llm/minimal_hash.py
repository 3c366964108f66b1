"""A minimal perfect hash of distinct 64-bit keys.

Each level is a bit array of twice as many bits as keys are left; a key that is
alone at its place there sets the bit and is done, the others try the next level
with another seed. A key's index is the number of set bits before its own, so n
keys take the indices 0..n-1. Keys that were not built in may get any index or
none; who looks up verifies the key stored at the index.
"""

from __future__ import annotations

import numpy as np

SPARSE = 2  # bits a key left at a level
LEVELS = 200


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64 bits for each seed."""
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x243F6A8885A308D3) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class MinimalHash:
    """index(keys) of the n keys it was built from are 0..n-1; -1 where no level holds a key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # words of 64 bits a level, and all words
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        rest, sizes, levels = keys.astype(np.uint64), [], []
        while len(rest):
            if len(sizes) == LEVELS:
                raise ValueError("keys of a minimal perfect hash must be distinct")
            words = -(-SPARSE * len(rest) // 64)
            place = (mixed(rest, len(sizes)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            rest = rest[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.sizes.tolist()):
            place = mixed(keys[left], level) % np.uint64(64 * words)
            word, bit = self.first[level] + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            held = self.bits[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.rank[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), self.bits.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes) -> MinimalHash:
        return cls(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, "<u8"))
