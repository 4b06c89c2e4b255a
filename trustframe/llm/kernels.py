"""Vectorised text kernels for Arrow batches: word spans, 64-bit word and shingle hashes.

A batch is worked on in slices of a few MB of text, so the arrays stay small however many rows
a batch has; one text longer than a slice is a slice of its own.  All word rules are rules on
bytes: the separators are ASCII, and no byte of a multi-byte UTF-8 sequence is ASCII, so the
words are the same as those of the character pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
#: multipliers of the words of a window, by place; windows are at most this long before they repeat
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: bytes of words for the pattern [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words that are runs of ASCII letters and digits or of any non-ASCII characters
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, every other byte unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: 1 for the first byte of each code point
CHAR = ((np.arange(256) & 0xC0) != 0x80)

_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and its inverse, for i < n; kept for the blocks of usual length."""
    if _pow["n"] < n:
        p = np.full(n, _BASE, np.uint64)
        q = np.full(n, _BASE_INV, np.uint64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        if n > 2 * _BLOCK:
            return p, q
        _pow.update(n=n, p=p, q=q)
    return _pow["p"][:n], _pow["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, end to end, and the offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, off = flat(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED):
    """Starts and ends of the words, and the index of each text's first word (texts + 1 of them)."""
    m = table[data]
    if not m.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = off[(off > 0) & (off < len(data))]
    before = np.zeros(len(m), bool)
    before[1:] = m[:-1]
    before[edge] = False
    start = np.flatnonzero(m & ~before)
    after = np.zeros(len(m), bool)
    after[:-1] = m[1:]
    after[edge - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(start, off)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (in order of start, not overlapping): equal bytes, equal hash."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        p, q = _powers(b - a + 1)
        c = np.empty(b - a + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTE[data[a:b]] * p[:b - a], out=c[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (c[e] - c[s]) * q[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def windows(words: np.ndarray, first: np.ndarray, k: int, short: bool = False):
    """Hashes of all k-word windows: (hash by place of its first word, whether it lies in one text).

    With ``short``, a text of 1 to k - 1 words has one window, its whole sequence."""
    n = len(words)
    g = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if not n:
        return g, ok
    counts = np.diff(first)
    if n >= k:
        m = n - k + 1
        for j in range(k):
            g[:m] += words[j:j + m] * (_PLACE[j % 64] + np.uint64(2 * (j // 64)))
        last = np.repeat(first[1:], counts)
        ok[:m] = np.arange(m) + k <= last[:m]
    if short:
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            w = words[first[d]:first[d + 1]]
            g[first[d]] = (w * _PLACE[:len(w)]).sum() + np.uint64(1 + len(w))
            ok[first[d]] = True
    return mix(g), ok


def codepoints(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (one more entry than bytes)."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(CHAR[data], out=c[1:])
    return c


def i64(x: np.ndarray) -> pa.Array:
    """uint64 or other integers as a Spark long."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
