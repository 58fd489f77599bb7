"""A minimal perfect hash over 64-bit keys, built level by level, all in numpy.

On each level the keys that are left are hashed into ``GAMMA`` places a key; those alone in
their place stay there, the others go on. A key's slot is the number of taken places before
its own on all levels: a lookup reads one bit a level and one rank, whatever the number of
keys.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64
_C1, _C2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finisher of SplitMix64, over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + _STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: each the bits of its places, as uint64 words; a rank is kept for every word."""
        self.levels = levels
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        self.ranks, at = [], 0
        for c in counts:
            ends = np.cumsum(c)
            self.ranks.append(at + ends - c)
            at += int(ends[-1]) if len(c) else 0
        self.n = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels, left = [], keys
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("the keys are not distinct")
            words = max(1, int(len(left) * GAMMA + 63) // 64)
            place = (mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            taken = np.bincount(place, minlength=words * 64) == 1
            levels.append(np.packbits(taken, bitorder="little").view("<u8"))
            left = left[~taken[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that are not in the set, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, words in enumerate(self.levels):
            place = mix(keys[open_], i) % np.uint64(len(words) * 64)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[i][word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return sizes.tobytes() + b"".join(w.astype("<u8").tobytes() for w in self.levels)

    @classmethod
    def load(cls, data: memoryview) -> tuple[PerfectHash, int]:
        """The hash, and how many bytes it took."""
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", n, 8).astype(int)
        at, levels = 8 * (n + 1), []
        for s in sizes:
            levels.append(np.frombuffer(data, "<u8", s, at))
            at += 8 * s
        return cls(levels), at
