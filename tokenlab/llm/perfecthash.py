"""A minimal perfect hash over 64-bit keys, in arrays: levels of bits where keys stand alone, ranked."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shared import mixed

#: Bits of a level for each key that comes to it; levels after which the few keys left are listed.
SPARE, LEVELS = 2, 24


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mixed(keys ^ mixed(np.array([level + 1], dtype=np.uint64))) % np.uint64(size)


@dataclass
class PerfectHash:
    """slot() numbers the n keys of build() from 0 to n - 1; of other keys it gives any of these, or -1."""

    bits: np.ndarray  # of all levels, in words of 64
    before: np.ndarray  # ones before each word
    sizes: np.ndarray  # bits of each level
    rest: np.ndarray  # sorted keys that no level holds

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """keys: distinct, uint64. A key that no other meets at its place of a level stays there, the others go on."""
        sizes, parts = [], []
        while len(keys) and len(sizes) < LEVELS:
            size = (SPARE * len(keys) + 63) // 64 * 64
            place = _place(keys, len(sizes), size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[place]]
        bits = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
        return PerfectHash(bits, before, np.array(sizes, dtype=np.int64), np.sort(keys))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"bits": self.bits, "before": self.before, "sizes": self.sizes, "rest": self.rest}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> PerfectHash:
        return PerfectHash(*(arrays[k] for k in ("bits", "before", "sizes", "rest")))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        out, open_, start = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(keys[open_], level, size) + np.uint64(start)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            own = self.bits[word]
            there = (own >> bit) & np.uint64(1) == 1
            below = own[there] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[open_[there]] = self.before[word[there]] + np.bitwise_count(below)
            open_, start = open_[~there], start + size
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.before[-1] + at[same]
        return out
