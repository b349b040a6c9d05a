"""Ascending numbers in two bits and a few low ones each, searched without being unpacked.

An Elias-Fano sequence keeps the low bits of each number side by side and the high bits in unary, as
one bit a number and one bit a step. Numbers are read, and successors found, from a directory of the
unary bits and a look at a few words; numpy does so for many places at a time. All parts are flat
arrays, so a sequence can lie in any buffer: a mapping of memory, a mapped file, an Arrow value.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Words of 64 bits between two entries of the directory; places looked up at a time.
WORDS, MANY = 4, 1 << 14

_ONE = np.uint64(1)


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, side by side in words, with a word of padding."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    shifts = np.arange(width, dtype=np.uint64)
    for at in range(0, len(values) if width else 0, MANY):  # MANY values fill whole words
        bits = (values[at : at + MANY, None] >> shifts & _ONE).astype(np.uint8)
        raw = np.packbits(bits, bitorder="little")
        start = at * width // 8
        out.view(np.uint8)[start : start + len(raw)] = raw
    return out


class EliasFano:
    """``values`` ascending (equal ones may follow each other), all below ``universe``."""

    def __init__(self, size: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.low, self.high, self.ones = size, low, high, ones
        self.n, self.width = int(size[0]), int(size[1])
        self.zeros = np.arange(len(ones), dtype=np.int64) * (WORDS * 64) - ones
        self.mask = np.uint64((1 << self.width) - 1)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        # a bit set for each number, a bit clear behind each value of the high part
        length = n + (max(universe - 1, 0) >> width) + 2
        blocks = -(-length // (WORDS * 64)) + 1
        bits = np.zeros(blocks * WORDS * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(words).reshape(-1, WORDS).sum(axis=1), out=ones[1:])
        return cls(np.array([n, width], np.int64), packed_bits(values & np.uint64((1 << width) - 1), width), words, ones)

    def parts(self) -> list[np.ndarray]:
        return [self.size, self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # of two words; shifting by 64 isn't defined, so by 63 and 1
        return (self.low[word] >> shift | self.low[word + 1] << (np.uint64(63) - shift) << _ONE) & self.mask

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th bit (from 0) of the kind."""
        before = self.ones if bit else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        left = (k - before[block]).astype(np.int64)
        words = self.high.reshape(-1, WORDS)[block]
        if not bit:
            words = ~words
        counts = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (counts <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left -= np.where(word > 0, counts[rows, word - 1], 0)
        x, place = words[rows, word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            place += np.where(up, half, 0)
            x = np.where(up, x >> np.uint64(half), x)
        return block * (WORDS * 64) + word * 64 + place

    def _ones_from(self, bit: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many set bits follow each other from the bit on, up to the zero of that number."""
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        after = np.minimum(word + 1, len(self.high) - 1)
        x = ~(self.high[word] >> shift | self.high[after] << (np.uint64(63) - shift) << _ONE)
        run = np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)
        long = np.flatnonzero(x == 0)
        if len(long):
            run[long] = self._select(high[long], 0) - bit[long]
        return run

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), MANY):
            k = i[at : at + MANY]
            high = (self._select(k, 1) - k).astype(np.uint64)
            out[at : at + MANY] = (high << np.uint64(self.width) | self._low(k)).astype(np.int64)
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x below the universe: the place of the first number that isn't less (n, if none
        is), and whether it equals x."""
        place, equal = np.empty(len(x), np.int64), np.empty(len(x), bool)
        for at in range(0, len(x), MANY):
            v = x[at : at + MANY].astype(np.uint64)
            high, want = (v >> np.uint64(self.width)).astype(np.int64), v & self.mask
            # numbers of a smaller high part stand in front of its zero
            bit = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1, 0)
            lo = bit - high
            end = lo + self._ones_from(bit, high)
            hi = end.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                less = self._low(mid) < want[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
                open_ = open_[lo[open_] < hi[open_]]
            place[at : at + MANY] = lo
            there = lo < end
            there[there] = self._low(lo[there]) == want[there]
            equal[at : at + MANY] = there
        return place, equal


def mapped(arrays: list[np.ndarray], path: str | None = None) -> mmap.mmap:
    """The arrays one behind the other in one mapping, with a directory in front: of anonymous memory,
    or of a file that is created."""
    head = np.array([len(arrays), *[v for a in arrays for v in (ord(a.dtype.kind), a.dtype.itemsize, len(a))]], np.int64)
    total = head.nbytes + sum(-(-a.nbytes // 8) * 8 for a in arrays)
    if path is None:
        out = mmap.mmap(-1, total)
    else:
        with open(path, "w+b") as f:
            f.truncate(total)
            out = mmap.mmap(f.fileno(), total)
    out[: head.nbytes] = head.tobytes()
    at = head.nbytes
    for a in arrays:
        out[at : at + a.nbytes] = np.ascontiguousarray(a).tobytes()
        at += -(-a.nbytes // 8) * 8
    return out


def arrays_of(buffer) -> list[np.ndarray]:
    """Views of the arrays of a mapping, or of any buffer with its bytes."""
    n = int(np.frombuffer(buffer, np.int64, 1)[0])
    head = np.frombuffer(buffer, np.int64, 3 * n, 8).reshape(-1, 3)
    at, out = 8 + head.nbytes, []
    for kind, size, length in head.tolist():
        out.append(np.frombuffer(buffer, np.dtype(f"{chr(kind)}{size}"), length, at))
        at += -(-size * length // 8) * 8
    return out
