"""Vectorised word scanning on Arrow string buffers.

A word is a maximal run of bytes other than U+0020 and U+0009..U+000D, found on
the UTF-8 bytes themselves, so no Python string is built for it.  Hashes are 64
bits wide; equal words have equal hashes wherever and whenever they are computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WINDOW = 1 << 19
_P = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over the others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {False: _table(False), True: _table(True)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    step = np.uint64(base & (2**64 - 1))
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * step
        done += k
        step = np.uint64(int(step) * int(step) & (2**64 - 1))
    return out


_UP = _powers(_P, _WINDOW + 1)
_DOWN = _powers(pow(_P, -1, 2**64), _WINDOW + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bufs = column.buffers()
    if len(column) == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def scan_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
    """(start, end, hash) of each word and, per row, the index of its first word (one more at the end)."""
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts, ends, out = [], [], []
    table = _TABLES[lower]
    at = 0
    while at < n:
        stop = min(n, at + _WINDOW)
        if stop < n:
            # a window ends at the last blank or row edge, or, for words longer than a window, grows
            while True:
                blank = np.flatnonzero(SPACE[data[at:stop]] | edge[at + 1 : stop + 1])
                if len(blank):
                    stop = at + int(blank[-1]) + 1
                    break
                if stop == n:
                    break
                stop = min(n, stop + _WINDOW)
        piece = data[at:stop]
        word = ~SPACE[piece]
        m = len(piece)
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[at + 1 : stop]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[at + 1 : stop]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        starts.append(s + at)
        ends.append(e + at)
        if hashes:
            up, down = (_UP, _DOWN) if m <= _WINDOW else (_powers(_P, m + 1), _powers(pow(_P, -1, 2**64), m + 1))
            acc = np.zeros(m + 1, dtype=np.uint64)
            np.cumsum(table[piece] * up[:m], out=acc[1:])
            out.append(mix((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64)))
        at = stop
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return s, e, h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(_P)
        acc += h[j : j + n]
    return mix(acc)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of word hashes (used where it is shorter than a shingle)."""
    acc = len(h)
    for x in h.tolist():
        acc = (acc * _P + x) & (2**64 - 1)
    return mix(np.array([acc], dtype=np.uint64))[0]


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; shorter sequences count as one shingle, none as no shingle."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    if len(h) < k:
        return np.array([whole(h)], dtype=np.uint64)
    x = np.sort(shingles(h, k))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 22):
    """Row ranges of a batch with about limit bytes of text each (a longer row stands alone)."""
    offs = text_bytes(batch.column(column))[1]
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
