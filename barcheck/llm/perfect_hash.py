"""Minimal perfect hash over 128-bit keys with fingerprint and count arrays, built and probed in numpy."""

from __future__ import annotations

import io

import numpy as np

_GOLDEN, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
LEVELS = 48


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h1 + np.uint64(_GOLDEN * (level + 1) & _WORD)) ^ (h2 * _MIX)
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Cascaded bit arrays: a key sits at the first level where it alone has its bit; its slot is the rank of that bit.

    Costs about three bits a key. Keys that no level separates (equal mixes, practically none) are kept in full behind the last
    rank, so the function is exact for every set of distinct keys.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.sizes: list[int] = []
        bits: list[np.ndarray] = []
        for level in range(LEVELS):
            if not len(h1):
                break
            size = 2 * len(h1) + 8
            at = _slots(h1, h2, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            stays = ~alone[at]
            h1, h2 = h1[stays], h2[stays]
        self.bits = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
        self.rest = np.stack([h1, h2], axis=1) if len(h1) else np.zeros((0, 2), np.uint64)
        self._ranks()

    def _ranks(self) -> None:
        flat = np.unpackbits(self.bits)[: sum(self.sizes)].astype(bool)
        self.flat, self.ranks = flat, np.cumsum(flat) - 1

    @classmethod
    def of(cls, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> PerfectHash:
        self = cls.__new__(cls)
        self.sizes, self.bits, self.rest = sizes.tolist(), bits, rest
        self._ranks()
        return self

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where no level has its bit; a foreign key may get the slot of another one."""
        out, open_, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = start + _slots(h1[open_], h2[open_], level, size)
            hit = self.flat[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_, start = open_[~hit], start + size
        last = int(self.flat.sum())
        for i, (a, b) in enumerate(self.rest):
            out[open_[(h1[open_] == a) & (h2[open_] == b)]] = last + i
        return out


class CountIndex:
    """Counts of keys behind a perfect hash; a 32-bit fingerprint tells foreign keys."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(h1, h2)
        at = self.hash.slots(h1, h2)
        most = int(counts.max()) if len(counts) else 0
        self.prints = np.zeros(len(h1), np.uint32)
        self.counts = np.zeros(len(h1), np.min_scalar_type(most))
        self.prints[at] = (h2 >> np.uint64(32)).astype(np.uint32)
        self.counts[at] = counts

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array(self.hash.sizes, np.int64), bits=self.hash.bits, rest=self.hash.rest, prints=self.prints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountIndex:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as x:
            self.hash = PerfectHash.of(x["sizes"], x["bits"], x["rest"])
            self.prints, self.counts = x["prints"], x["counts"]
        return self

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Count of every key, 0 for a key that is not in the index."""
        at = self.hash.slots(h1, h2)
        out = np.zeros(len(h1), np.int64)
        found = at >= 0
        same = self.prints[at[found]] == (h2[found] >> np.uint64(32)).astype(np.uint32)
        out[found] = np.where(same, self.counts[at[found]], 0)
        return out
