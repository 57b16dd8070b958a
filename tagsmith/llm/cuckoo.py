"""A cuckoo filter over pairs of 64-bit hashes, with vectorised inserts, deletions and probes."""

from __future__ import annotations

import numpy as np

SLOTS = 4


class Full(Exception):
    """No place is left: build a larger filter from the exact table behind it."""


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def for_keys(n: int, load: float = 0.8) -> CuckooFilter:
        return CuckooFilter(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * load))))))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return CuckooFilter(len(table), table)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (np.asarray(h2).astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        return (np.asarray(h1).astype(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64), np.where(mark == 0, np.uint16(1), mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, mark = self._places(h1, h2)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[self._other(a, mark)] == mark[:, None]).any(1)

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Place what its bucket has room for; which are left."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(b) else np.zeros(0, np.int64)
        empty = self.table[b] == 0
        nth = np.cumsum(empty, 1)
        fits = rank < nth[:, -1] if len(b) else np.zeros(0, bool)
        slot = np.argmax(empty & (nth == rank[:, None] + 1), 1)
        self.table[b[fits], slot[fits]] = mark[order][fits]
        return order[~fits]

    def insert(self, h1: np.ndarray, h2: np.ndarray, rounds: int = 500) -> None:
        bucket, mark = self._places(h1, h2)
        rng = np.random.default_rng(len(bucket))
        for k in range(rounds):
            left = self._settle(bucket, mark)
            if not len(left):
                return
            bucket, mark = self._other(bucket[left], mark[left]), mark[left]
            if k % 2:  # both buckets are full: push one mark out of each
                _, one = np.unique(bucket, return_index=True)
                slot = rng.integers(0, SLOTS, len(one))
                out = self.table[bucket[one], slot].copy()
                was = out != 0
                self.table[bucket[one], slot] = mark[one]
                mark[one[was]], gone = out[was], one[~was]
                bucket[one[was]] = self._other(bucket[one[was]], mark[one[was]])
                bucket, mark = np.delete(bucket, gone), np.delete(mark, gone)
                if not len(bucket):
                    return
        raise Full

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Takes one mark out for each key; all keys must have been inserted."""
        a, mark = self._places(h1, h2)
        b = self._other(a, mark)
        while len(a):
            in_a, in_b = self.table[a] == mark[:, None], self.table[b] == mark[:, None]
            use_a = in_a.any(1)
            if not (use_a | in_b.any(1)).all():
                raise KeyError("a key that isn't in the filter")
            bucket, slot = np.where(use_a, a, b), np.where(use_a, in_a.argmax(1), in_b.argmax(1))
            _, one = np.unique(bucket * SLOTS + slot, return_index=True)
            self.table[bucket[one], slot[one]] = 0
            a, b, mark = (np.delete(x, one) for x in (a, b, mark))
