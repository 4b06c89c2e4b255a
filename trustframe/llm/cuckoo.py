"""A cuckoo filter over 16-byte keys: 4 slots a bucket, 16-bit fingerprints, deletable."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    return x


def as_words(keys) -> np.ndarray:
    """16-byte keys as an (n, 2) array of uint64."""
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class Cuckoo:
    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) of uint16, 0 is free; buckets is a power of two

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        """Room for n keys at a load of two thirds or less."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, 1.5 * n) / SLOTS))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        size = len(keys)
        while True:
            f = cls.for_keys(size)
            if all(f.insert(*p) for p in zip(*f._places(keys))):
                return f
            size *= 2

    def _places(self, keys: np.ndarray):
        """Fingerprints and first buckets, as lists."""
        fp = (keys[:, 1] >> np.uint64(48)).astype(np.int64)
        fp[fp == 0] = 1
        return fp.tolist(), (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64).tolist()

    def _other(self, i: int, fp: int) -> int:
        return i ^ ((fp * 0x5BD1E995 >> 3) & (len(self.table) - 1))

    def insert(self, fp: int, i: int) -> bool:
        t = self.table
        for b in (i, self._other(i, fp)):
            free = np.flatnonzero(t[b] == 0)
            if len(free):
                t[b, free[0]] = fp
                return True
        b = i
        for turn in range(KICKS):
            s = (turn * 7 + fp) % SLOTS
            fp, t[b, s] = int(t[b, s]), fp
            b = self._other(b, fp)
            free = np.flatnonzero(t[b] == 0)
            if len(free):
                t[b, free[0]] = fp
                return True
        return False  # full: the shard is built anew from the exact table

    def delete(self, fp: int, i: int) -> bool:
        for b in (i, self._other(i, fp)):
            at = np.flatnonzero(self.table[b] == fp)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def update(self, keys: np.ndarray, add: np.ndarray) -> bool:
        """Deletes, then inserts; False if a key had no room."""
        fps, places = self._places(keys)
        for want in (False, True):
            for fp, i, a in zip(fps, places, add):
                if bool(a) == want and not (self.insert(fp, i) if want else self.delete(fp, i)):
                    return False
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, i = (np.array(x, np.int64) for x in self._places(keys))
        j = i ^ ((fp * 0x5BD1E995 >> 3) & (len(self.table) - 1))
        want = fp.astype(np.uint16)[:, None]
        return (self.table[i] == want).any(1) | (self.table[j] == want).any(1)

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())
