"""Vectorised text kernels over Arrow string buffers.

Texts of one batch lie end to end in one byte buffer; words, shingles and
windows are found and hashed with whole-array numpy operations, never per row.
All hashes are 64 bit and depend on content alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import worker_cache

BLOCK = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


def _random_table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)


_BYTE = _random_table(11, 256)
_BYTE[0] = 0


def fold_table(mode: str) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte with ASCII letters lowered.

    ``ws``: words are runs of anything but ASCII white space.
    ``alnum``: words are runs of ASCII letters, digits and bytes above 127.
    """
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 1
    if mode == "ws":
        t[[9, 10, 11, 12, 13, 32]] = 0
    else:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        t[~keep] = 0
    return t


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept in the process, not in the module."""
    cache = worker_cache()
    have = cache.get(("pow", base))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = cache[("pow", base)] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = BLOCK):
    """(lo, hi) row ranges of about ``limit`` bytes; a longer row stands alone."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _spans(data, offs, table):
    f = table[data]
    w = f != 0
    edge = np.zeros(len(w) + 1, bool)
    edge[offs] = True
    before = np.empty_like(w)
    before[:1] = False
    before[1:] = w[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(w)
    after[-1:] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    return f, np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def span_hash(f: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte=_BYTE) -> np.ndarray:
    """Polynomial hash of f[start:end] for non-empty spans, in blocks of memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + 4 * BLOCK, "right")))
        hi = ends[j - 1]
        up, down = powers(_P, hi - lo)
        c = byte[f[lo:hi]]
        c *= up[: hi - lo]
        np.cumsum(c, out=c)
        a, b = starts[i:j] - lo, ends[i:j] - lo
        h = c[b - 1]
        h[a > 0] -= c[a[a > 0] - 1]
        h *= down[a]
        out[i:j] = h + (b - a).astype(np.uint64) * _U(0x8CB92BA72F3D8DD7)
        i = j
    return mix(out)


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(row, start byte, end byte, hash) of every word, in order."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    f, s, e = _spans(data, offs, table)
    row = np.searchsorted(offs, s, "right") - 1
    return row, s, e, span_hash(f, s, e)


def shingles(row: np.ndarray, h: np.ndarray, n: int, short: bool = True):
    """(row, position, hash) of every run of n words within one row.

    With ``short`` a row of 1 to n-1 words gives one shingle of all its words.
    """
    m = len(h) - n + 1
    if m > 0:
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g *= _U(_Q)
            g += h[j : j + m]
        ok = row[:m] == row[n - 1 :]
        at = np.flatnonzero(ok)
        r, g = row[at], mix(g[at])
    else:
        at, r, g = np.zeros(0, np.int64), row[:0], np.zeros(0, np.uint64)
    if short and len(row) and n > 1:
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[first, len(row)])
        few = first[size < n]
        if len(few):
            x = np.zeros(len(few), np.uint64)
            k = size[size < n]
            for j in range(n - 1):
                on = k > j
                x[on] = x[on] * _U(_Q) + h[few[on] + j]
            at, r, g = np.r_[at, few], np.r_[r, row[few]], np.r_[g, mix(x + k.astype(np.uint64))]
            o = np.argsort(at, kind="stable")
            at, r, g = at[o], r[o], g[o]
    return r, at, g


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for every i (rolling, by prefix sums)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_Q, len(h))
    c = np.cumsum(h * up[: len(h)])
    w = c[n - 1 :].copy()
    w[1:] -= c[: m - 1]
    w *= down[:m]
    return mix(w)


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the minimum of v[i:i+w] for every i, the rightmost among equals."""
    m = len(v) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at, span = v, np.arange(len(v)), 1
    while span < w:
        step = min(span, w - span)
        n = len(best) - step
        right = best[step:] <= best[:n]
        best, at = np.where(right, best[step:], best[:n]), np.where(right, at[step:], at[:n])
        span += step
    return at


def groups(sorted_key: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])


def long_column(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))
