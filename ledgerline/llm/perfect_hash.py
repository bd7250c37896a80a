"""Minimal perfect hash of 64-bit keys: levels of bit arrays, as wide as twice the keys that are left.

A key sets the bit that its hash of the level names; where two keys meet, both go on to the next level.
A key's slot is the number of bits before its own, so n keys have the slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from ledgerline.llm.common import mix

LEVELS = 64


def _spots(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    x = mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    def __init__(self, bits: np.ndarray, widths: np.ndarray) -> None:
        self.bits, self.widths = bits, widths
        self.before = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while left.size:
            if len(levels) == LEVELS:
                raise ValueError("two keys are alike")
            at = _spots(left, len(levels), max(64, 2 * left.size))
            levels.append(np.bincount(at, minlength=max(64, 2 * left.size)) == 1)
            left = left[~levels[-1][at]]
        return cls(np.concatenate([np.zeros(0, bool), *levels]), np.array([x.size for x in levels], np.int32))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; any slot or -1 for keys that it was not built of: compare them with the stored key."""
        out, todo, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for level, width in enumerate(self.widths.tolist()):
            at = base + _spots(keys[todo], level, width)
            hit = self.bits[at]
            out[todo[hit]] = self.before[at[hit]]
            todo, base = todo[~hit], base + width
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.packbits(self.bits).tobytes(), self.widths.tobytes()

    @classmethod
    def load(cls, bits: bytes, widths: bytes) -> PerfectHash:
        wide = np.frombuffer(widths, np.int32)
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(wide.sum())).astype(bool), wide)
