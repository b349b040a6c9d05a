"""Arrow string columns as flat byte arrays, and words on them, without a Python object per word.

Every operator that looks at words works on the UTF-8 bytes that Arrow already holds: a class
table marks the bytes of words, and a word's hash is the difference of two prefix sums, so the
cost is a few passes over the bytes whatever the words look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that the numpy passes take at a time; a longer text is taken alone, whole.
SLICE_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers that depend on the seed alone, alike on every executor."""
    start = (seed * 0x5851F42D4C957F2D) % (1 << 64)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(start)) * _ODD)


def lower_table() -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_table() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing). As every byte
    of a non-ASCII character is 0x80 or more, the byte table equals the character class."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def spaced_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[9:14] = t[32] = False
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most so many bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of rows [i, j): ``start`` and ``end`` (bytes), ``hash`` and, by row, ``first``
    (word offsets, one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashes: bool = True):
        lower = lower_table()[data]
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = table[lower]
        heads = inside[:-1].copy()
        heads[1:] &= ~inside[:-2]
        rows = offsets[:-1][offsets[:-1] < len(data)]
        heads[rows] = inside[rows]  # a word never runs from one row into the next
        self.data = lower
        self.start = np.flatnonzero(heads)
        tails = inside[:-1] & ~inside[1:]
        tails[rows[rows > 0] - 1] = inside[rows[rows > 0] - 1]
        self.end = np.flatnonzero(tails) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = span_hash(lower, self.start, self.end)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = random_words(256, 11)


def _grown(n: int) -> None:
    """Powers of the base and of its inverse, up to n."""
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverse", _BACK)):
                p = np.ones(1, np.uint64)
                while len(p) < n:
                    p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
                globals()[name] = p


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of byte values times powers of an
    odd base: multiplying by the inverse power makes it independent of the place."""
    _grown(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of k consecutive word hashes, for every place where k words follow."""
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _ODD + words[i : i + n]
            h ^= h >> np.uint64(29)
        return mix(h)


def span_gram_hash(words: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """A hash of k consecutive word hashes from each of the given places on, at a cost that doesn't
    grow with k: by prefix sums, like ``span_hash``."""
    _grown(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers[: len(words)], out=total[1:])
        return mix((total[start + k] - total[start]) * _inverse[start])


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
