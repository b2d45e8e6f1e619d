"""Vectorised word scanning and hashing over Arrow string columns.

Texts are looked at as UTF-8 bytes in slices of a few megabytes, so memory depends on the slice (or on the one
text that is longer than a slice), never on the number of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_pow: np.ndarray = np.ones(1, np.uint64)
_inv: np.ndarray = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: For a second hash.
OTHER_CODE = mix(_BYTE_CODE ^ np.uint64(0x5851F42D4C957F2D))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            _pow = np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD)]).cumprod(dtype=np.uint64)
            _inv = np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]).cumprod(dtype=np.uint64)
    return _pow[:n], _inv[:n]


def table_of(*bytes_: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(bytes_)] = True
    return t


#: Between words: space and the controls 9 to 13.
SPACE = table_of(0x20, *range(0x09, 0x0E))
#: Between words for matching: all of ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: First bytes of the characters U+3000 to U+9FFF, of scripts without spaces.
UNSPACED = table_of(*range(0xE3, 0xEA))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


class Slice:
    """Some consecutive texts: ``data`` (their bytes), ``off`` (len(texts)+1 offsets), ``first`` (row of the first)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first = data, off, first
        self.n = len(off) - 1

    def words(self, separator: np.ndarray = SPACE, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (byte positions) and text number of each word: a longest run without separators in one text. Each
        character of three bytes whose first is in ``alone`` is a word of its own."""
        inside = ~separator[self.data]
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        edge = np.zeros(n + 1, bool)
        edge[self.off[self.off < n]] = True
        edge[n] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        if alone is not None and len(lead := np.flatnonzero(alone[self.data])):
            begin[lead] = True
            end[lead[lead > 0] - 1] = inside[lead[lead > 0] - 1]
            end[lead + 2] = True
            after = lead[lead + 3 < n] + 3
            begin[after] |= inside[after] & ~edge[after]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(self.off, s, "right") - 1

    def hashes(self, s: np.ndarray, e: np.ndarray, fold: np.ndarray = SAME, code: np.ndarray = _BYTE_CODE) -> np.ndarray:
        """A 64-bit hash of each byte range, equal wherever the (folded) bytes are equal. Starts have to ascend."""
        out = np.empty(len(s), np.uint64)
        own, i = code[fold], 0
        while i < len(s):  # starts ascend: a megabyte at a time, or one range
            j = max(i + 1, int(np.searchsorted(s, s[i] + SLICE_BYTES)))
            low, high = int(s[i]), int(e[i:j].max())
            p, inv = _powers(high - low + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(high - low + 1, np.uint64)
                np.cumsum(own[self.data[low:high]] * p[:-1], dtype=np.uint64, out=total[1:])
                out[i:j] = mix((total[e[i:j] - low] - total[s[i:j] - low]) * inv[s[i:j] - low] + (e[i:j] - s[i:j]).astype(np.uint64) * _ODD)
            i = j
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES, lower: bool = False) -> Iterator[Slice]:
    """The column (nulls as empty texts) as slices of at most ``limit`` bytes or one text; in lower case if asked for."""
    if lower:
        column = pc.utf8_lower(column)  # one code point for one
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def window_hashes(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` word hashes within one owner, and the index of the first word of each."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + k]
    return mix(h), at


def tidy(run):
    """``run`` for mapInArrow; when a task ends, memory that its worker doesn't use goes back to the system."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum (or count) by text number, as int64."""
    return np.bincount(owner, weights, n).astype(np.int64)
