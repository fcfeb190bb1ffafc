"""Vectorised text kernels over Arrow buffers (numpy only).

A column of texts is one byte buffer plus offsets.  Words are found and hashed for
the whole buffer at once: with a random 64-bit value per byte and powers of an odd
multiplier, a prefix sum gives the polynomial hash of any word as a difference, so
no Python code runs per word or per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(7919)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = LOWER_VALUES[97:123]
GRAM_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20
_M1, _M2, _S33 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_scratch = np.empty(CHUNK + 1, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse.  Those for a run of usual length are kept;
    a longer text has its own, which go with it."""
    if n <= len(_powers[0]):
        return _powers[0], _powers[1]
    own = []
    for p in (_P, _P_INV):
        t = np.full(max(n, CHUNK + 1), p, np.uint64)
        t[0] = 1
        own.append(np.multiply.accumulate(t))
    if n <= CHUNK + 1:
        _powers[:] = own
    return own[0], own[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(bounds: np.ndarray, size: int = CHUNK):
    """(first, last) ranges of rows of about ``size`` bytes and 65536 rows at most; one long
    row stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = min(max(j, i + 1), n, i + 65536)
        yield i, j
        i = j


LOADED = 64


def _loaded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z in lower case, by 8 bytes at a time: a few steps a word, not a few a byte.
    The others' polynomial takes words of over LOADED bytes."""
    own = np.concatenate((buf, np.zeros(8, np.uint8)))
    own |= (own - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5)
    at = np.ndarray((len(buf),), "<u8", own, strides=(1,))
    size = end - start

    def load(word, k):
        bits = (np.minimum(size[word] - k, 8) << 3).astype(np.uint64)
        return at[start[word] + k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - bits))

    out = mix(load(slice(None), 0) + size.astype(np.uint64) * GRAM_MULT[0])
    word = np.arange(len(size))
    for k in range(8, LOADED, 8):
        word = word[size[word] > k]
        if not len(word):
            break
        out[word] = mix(out[word] * GRAM_MULT[1] + load(word, k))
    long = np.flatnonzero(size > LOADED)
    if len(long):
        bounds = np.append(0, np.cumsum(size[long]))
        out[long] = Words(buf[np.arange(bounds[-1]) + np.repeat(start[long] - bounds[:-1], size[long])], bounds).hash
    return out


class Words:
    """Words of a run of rows: ``start``, ``end`` (byte positions), ``row``, ``hash``;
    words of row r are ``first[r]:first[r + 1]``.  ``loaded``: other hashes, in less time."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, values: np.ndarray = LOWER_VALUES, breaks: np.ndarray = SPACE, loaded: bool = False):
        n = len(buf)
        rows = len(bounds) - 1
        if n == 0:
            self.start = self.end = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            self.row = np.empty(0, np.int64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        # white space is 9 to 13 and 32; numbers under 9 wrap around
        word = (buf - np.uint8(9) > np.uint8(4)) & (buf != 32) if breaks is SPACE else ~breaks[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        opens = int(word[0])  # edges open and close words by turns
        inner = np.unique(bounds[(bounds > 0) & (bounds < n)])
        inner = inner[word[inner - 1] & word[inner]]
        start = np.concatenate((np.zeros(opens, np.int64), edge[opens::2]))
        end = np.concatenate((edge[1 - opens :: 2], np.full(int(word[-1]), n)))
        if len(inner):
            start, end = (np.insert(x, np.searchsorted(x, inner), inner) for x in (start, end))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, bounds)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        if loaded:
            self.hash = _loaded(buf, start, end)
            return
        power, inverse = _tables(n + 1)
        total = _scratch[: n + 1] if n <= CHUNK else np.empty(n + 1, np.uint64)
        total[0] = 0
        np.take(values, buf, out=total[1:], mode="clip")
        total[1:] *= power[:n]
        np.cumsum(total, out=total)
        self.hash = mix((total[end] - total[start]) * inverse[start])


def words(buf: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of many rows, without their places, in pieces of usual length."""
    parts = [(i, Words(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])) for i, j in chunks(bounds)]
    out = Words(buf[:0], np.zeros(1, np.int64))
    if parts:
        before = np.cumsum([0, *(len(w.hash) for _, w in parts)])
        out.hash = np.concatenate([w.hash for _, w in parts])
        out.row = np.concatenate([w.row + i for i, w in parts])
        out.first = np.concatenate([*(w.first[:-1] + n for (_, w), n in zip(parts, before, strict=False)), before[-1:]])
    return out


def grams(hashes: np.ndarray, first: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all windows of ``k`` words; a row with 1..k-1 words gives
    one window, its whole sequence."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = np.diff(first)
    out = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * GRAM_MULT[j] if n >= k else out
    ok = row[: len(out)] == row[k - 1 :] if n >= k else np.zeros(0, bool)
    values, rows = mix(out[ok]), row[: len(out)][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += hashes[first[short[has]] + j] * GRAM_MULT[j]
        extra = mix(extra + count[short].astype(np.uint64) * GRAM_MULT[63])
        at = np.searchsorted(rows, short)
        values, rows = np.insert(values, at, extra), np.insert(rows, at, short)
    return values, rows


BITS = np.uint64(48)
LOW48 = np.uint64((1 << 48) - 1)


def distinct(values: np.ndarray, rows: np.ndarray, first_row: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit values of each row, ascending by (row, value).  At most 65536 rows."""
    key = ((rows - first_row).astype(np.uint64) << BITS) | (values & LOW48)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & LOW48, (key >> BITS).astype(np.int64) + first_row


def set_ids(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit id) of each row's distinct set; the id doesn't depend on order."""
    size = np.bincount(rows, minlength=n_rows)
    ids = np.zeros(n_rows, np.uint64)
    at = np.flatnonzero(size)
    if len(values):
        begins = np.concatenate(([0], np.cumsum(size[at])[:-1]))
        ids[at] = np.add.reduceat(mix(values + np.uint64(0x51ED270B)), begins)
    return size, mix(ids + size.astype(np.uint64)).view(np.int64)
