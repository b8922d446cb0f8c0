"""A minimal perfect hash function over 128-bit keys, after the level scheme of BBHash.

Level l hashes the keys that are left into an array of ``GAMMA`` slots per key. Keys alone in their slot are settled there,
the others go on to level l + 1. The rank of a settled slot among all settled slots is the key's number: n keys get the
numbers 0 .. n-1, at about three bits a key, and the keys themselves are not kept.
"""

from __future__ import annotations

import numpy as np

from cohortia.llm.common import mix, stream

GAMMA = 2.0


def _place(h1: np.ndarray, h2: np.ndarray, level: int, slots: int) -> np.ndarray:
    z = mix(h1 + stream(level)) ^ h2
    return (mix(z) % np.uint64(slots)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], bytes]:
    """Slots of each level, and the settled slots of all levels as a bit array. The keys have to be distinct."""
    sizes, bits = [], []
    while len(h1):
        slots = max(1, int(len(h1) * GAMMA))
        at = _place(h1, h2, len(sizes), slots)
        n = np.bincount(at, minlength=slots)
        bits.append(n == 1)
        sizes.append(slots)
        left = n[at] > 1
        h1, h2 = h1[left], h2[left]
        if len(sizes) > 200:
            raise ValueError("the keys are not distinct")
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b""


class Lookup:
    """Numbers of keys; a key that was not among those built from gets -1 or the number of another one."""

    def __init__(self, sizes: list[int], packed: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - self.bits

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        todo, base = np.arange(len(h1)), 0
        for level, slots in enumerate(self.sizes):
            at = base + _place(h1[todo], h2[todo], level, slots)
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
            base += slots
            if not len(todo):
                break
        return out
