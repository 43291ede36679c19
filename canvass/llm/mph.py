"""Minimal perfect hash over 64-bit keys, built level by level with NumPy.

On each level the keys left are thrown into a bit array; those alone at their place stay there and the
rest go on to the next level. A key's number is the count of set bits before its place, so that n keys
get the numbers 0 to n - 1. A key outside the set gets any number or -1: callers compare what is
stored under the number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from canvass.llm.spans import U, mix


@dataclass
class MinimalPerfectHash:
    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 1.5) -> MinimalPerfectHash:
        """keys: distinct uint64."""
        left, sizes, parts = keys.astype(np.uint64), [], []
        while len(left):
            size = max(8, int(len(left) * spread))
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[place]]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        return cls(sizes, bits, np.cumsum(bits) - bits)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U(size)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            place = base + self._place(keys[todo], level, size)
            hit = self.bits[place]
            out[todo[hit]] = self.before[place[hit]]
            todo, base = todo[~hit], base + size
        return out
