"""Vectorised word and shingle hashing over Arrow string buffers.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are
lower-cased; all delimiters are ASCII, so working on UTF-8 bytes is exact.
Hashes are 64 bit.  Nothing here depends on the size of the corpus: a batch is
cut into slices of a few MB (a longer document forms a slice alone).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_INV = _U(pow(0x9E3779B97F4A7C55, -1, 1 << 64))

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_rng = np.random.RandomState(20240607)
_BYTE = _rng.randint(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
BYTE_LOWER = _BYTE[_low]      # value of a byte after lower-casing A-Z
BYTE_EXACT = _BYTE            # value of a byte as it is
_COEF = _rng.randint(0, 1 << 62, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Cache(dict):
    """Per-process cache; sent to a worker it arrives empty."""

    def __reduce__(self):
        return Cache, ()


_POW = Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, SLICE_BYTES + 1)
        for k, b in (("p", _BASE), ("i", _INV)):
            a = np.full(m, b, _U)
            a[0] = _U(1)
            _POW[k] = np.cumprod(a)
    p, i = _POW["p"][:n], _POW["i"][:n]
    if len(_POW["p"]) > 8 * SLICE_BYTES:  # keep no buffer of a giant document
        _POW.clear()
    return p, i


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if big else np.int32, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b, o


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD):
    """Starts and ends of words in ``buf`` (documents at ``offs``, the first 0),
    and per document the index of its first word (one entry more)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = is_word[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    left = np.empty(n, bool)
    left[0], left[1:] = True, ~w[:-1]
    left |= cut[:n]
    starts = np.flatnonzero(w & left)
    right = np.empty(n, bool)
    right[-1], right[:-1] = True, ~w[1:]
    right |= cut[1:]
    ends = np.flatnonzero(w & right) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """64-bit hash of each byte span."""
    p, inv = _powers(len(buf) + 1)
    s = np.zeros(len(buf) + 1, _U)
    np.cumsum(table[buf] * p[: len(buf)], out=s[1:])
    return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(_U))


def windows_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` consecutive word hashes from each position."""
    if len(h) < k:
        return np.zeros(0, _U)
    acc = h[: len(h) - k + 1] * _COEF[0]
    for j in range(1, k):
        acc = acc + h[j: len(h) - k + 1 + j] * _COEF[j]
    return mix(acc + _U(k))


def shingle_sets(column, k: int = SHINGLE):
    """Per row of an Arrow string column its number of words and its sorted
    distinct ``k``-word shingle hashes.  Fewer words: the whole sequence as one
    shingle; without words (or null): none."""
    buf, offs = buffers(column)
    for i, j in slices(offs):
        b, o = buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        st, en, first = spans(b, o)
        h = span_hash(b, st, en) if len(st) else np.zeros(0, _U)
        win = windows_of(h, k)
        for r in range(j - i):
            a, z = int(first[r]), int(first[r + 1])
            if z - a >= k:
                yield z - a, np.unique(win[a: z - k + 1])
            elif z > a:
                yield z - a, windows_of(h[a:z], z - a)
            else:
                yield 0, np.zeros(0, _U)
