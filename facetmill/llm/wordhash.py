"""Words and word shingles as 64-bit hashes, whole Arrow batches at a time.

A word is a maximal run of bytes other than space and tab to carriage return, with A-Z lower-cased;
UTF-8 keeps those bytes out of longer characters, so bytes suffice. The hash of a word is a
polynomial over random byte values modulo 2**64, read off prefix sums; a shingle mixes the hashes
of its words. Two different shingles collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (two rounds of multiply and shift)."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=_U)
_FOLD[65:91] += _U(32)
with np.errstate(over="ignore"):
    _BYTE = mix((_FOLD + _U(1)) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least."""
    if len(_powers[0]) < n:
        for k, b in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, PIECE + 1), b, dtype=_U)
            a[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(a, dtype=_U)
    return _powers[0], _powers[1]


def _words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of raw; no word goes across breaks (sorted offsets)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, _U)
    sep = _SEPARATOR[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[breaks[(breaks >= 0) & (breaks <= n)]] = True
    edge[0] = edge[n] = True
    before = np.concatenate(([True], sep[:-1])) | edge[:-1]
    after = np.concatenate((sep[1:], [True])) | edge[1:]
    start = np.flatnonzero(~sep & before)
    end = np.flatnonzero(~sep & after) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(_BYTE[raw] * up[:n], dtype=_U, out=total[1:])
        return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, offsets and validity of a string column."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n, bufs = len(column), column.buffers()
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool)
    offsets = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    valid = np.ones(n, dtype=bool) if not column.null_count else np.asarray(column.is_valid())
    return data, offsets, valid


def _long(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, in pieces cut at separators."""
    out, at = [], 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        while to < len(raw) and not _SEPARATOR[raw[to]]:
            more = np.flatnonzero(_SEPARATOR[raw[to : to + PIECE]])
            to = to + int(more[0]) if len(more) else min(to + PIECE, len(raw))
        out.append(_words(raw[at:to], np.empty(0, np.int64))[1])
        at = to
    return np.concatenate(out) if out else np.empty(0, _U)


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text in order; of nulls, none."""
    data, offsets, valid = _bytes(column)
    n, row = len(valid), 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        if offsets[row + 1] - offsets[row] > PIECE:
            yield _long(data[offsets[row] : offsets[row + 1]]) if valid[row] else np.empty(0, _U)
            row += 1
            continue
        last = min(last, n)
        lo = offsets[row]
        cut = (offsets[row : last + 1] - lo).astype(np.int64)
        start, h = _words(data[lo : offsets[last]], cut)
        where = np.searchsorted(start, cut)
        for k in range(last - row):
            yield h[where[k] : where[k + 1]] if valid[row + k] else h[:0]
        row = last


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of fewer words, one of the whole sequence."""
    n = len(words)
    if not n:
        return words
    width = k if n >= k else n
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, _U(width if n < k else 0), dtype=_U)
        for i in range(width):
            out = (out + words[i : n - width + 1 + i]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(29)
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(words, k))
