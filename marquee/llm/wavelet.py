"""Wavelet matrix: bit-planes of a token sequence with rank and select."""

from __future__ import annotations

import numpy as np

_BLOCK = 512
#: Symbols that are dealt out at a time.
_STEP = 1 << 16


def directory(packed: bytes) -> bytes:
    """The number of ones before each block of 512 bits, as little-endian 64-bit integers."""
    words = np.frombuffer(packed + b"\0" * (-len(packed) % 64), "<u8").reshape(-1, 8)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    return (np.cumsum(ones) - ones).astype("<i8").tobytes()


class Plane:
    """Bits, packed, with the number of ones before each block of 512 bits as it was stored.

    Few ranks are answered from these; for many, the ones before each word are counted once.
    """

    def __init__(self, packed: bytes, before: bytes, n: int):
        self.words, self.n = np.frombuffer(packed + b"\0" * (8 - len(packed) % 8), ">u8"), n
        self.before, self.table = np.frombuffer(before, "<i8"), None

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        i = np.asarray(i, np.int64)
        if not self.n:
            return np.zeros_like(i)
        word, rest = i >> 6, i & 63
        if self.table is None and 64 * i.size > len(self.words):
            ones = np.bitwise_count(self.words).astype(np.int64)
            self.table = np.cumsum(ones) - ones
        if self.table is not None:
            out = self.table[word]
        else:
            block = np.minimum(word >> 3, len(self.before) - 1)
            out = self.before[block].copy()
            for k in range(_BLOCK // 64):
                at = np.minimum(8 * block + k, len(self.words) - 1)
                out += np.where(8 * block + k < word, np.bitwise_count(self.words[at]), 0)
        part = self.words[word].astype(np.uint64) >> ((64 - rest) & 63).astype(np.uint64)
        return out + np.where(rest > 0, np.bitwise_count(part), 0)

    def bit(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self.words[i >> 6].astype(np.uint64) >> (63 - (i & 63)).astype(np.uint64)) & np.uint64(1)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero, by binary search over ranks."""
        k = np.asarray(k, np.int64)
        low, high = np.zeros_like(k), np.full_like(k, self.n)
        while (low < high).any():
            mid = (low + high) >> 1
            ones = self.rank1(mid + 1)
            enough = (ones if one else mid + 1 - ones) > k
            high, low = np.where(enough, mid, high), np.where(enough, low, mid + 1)
        return low


class WaveletMatrix:
    """Access, rank and select over a sequence of symbols below 2 ** width."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.width, self.zeros = n, width, zeros
        self.raw, self.ranks, self._planes = planes, ranks, [None] * width

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        n, planes, zeros, one = len(values), [], [], values.dtype.type(1)
        for k in range(width - 1, -1, -1):
            bit = ((values >> values.dtype.type(k)) & one).astype(bool)
            packed = np.packbits(bit)
            planes.append(packed.tobytes())
            zeros.append(n - int(np.bitwise_count(packed).sum(dtype=np.int64)))
            after, low, high = np.empty_like(values), 0, zeros[-1]
            for a in range(0, n, _STEP):
                part, own = values[a : a + _STEP], bit[a : a + _STEP]
                ones = part.take(np.flatnonzero(own))
                after[low : low + len(part) - len(ones)] = part.take(np.flatnonzero(~own))
                after[high : high + len(ones)] = ones
                low, high = low + len(part) - len(ones), high + len(ones)
            values = after
        return cls(len(values), width, zeros, planes, [directory(p) for p in planes])

    def plane(self, level: int) -> Plane:
        if self._planes[level] is None:
            self._planes[level] = Plane(self.raw[level], self.ranks[level], self.n)
        return self._planes[level]

    def decode(self) -> np.ndarray:
        """The whole sequence: each plane's partition is undone from the last to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(np.frombuffer(self.raw[level], np.uint8), count=self.n).view(bool)
            back, low, high = np.empty(self.n, kind), 0, self.zeros[level]
            values[high:] |= kind(1 << (self.width - 1 - level))
            for a in range(0, self.n, _STEP):
                part, own = back[a : a + _STEP], bit[a : a + _STEP]
                ones = np.flatnonzero(own)
                part[np.flatnonzero(~own)] = values[low : low + len(part) - len(ones)]
                part[ones] = values[high : high + len(ones)]
                low, high = low + len(part) - len(ones), high + len(ones)
            values = back
        return values

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        for level in range(self.width):
            plane = self.plane(level)
            bit, ones = plane.bit(i).astype(bool), plane.rank1(i)
            out = out << 1 | bit.astype(np.int64)
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in [0, i)."""
        symbol, i = np.broadcast_arrays(np.asarray(symbol, np.int64), np.asarray(i, np.int64))
        low = np.zeros(len(i), np.int64)
        for level in range(self.width):
            plane, bit = self.plane(level), (symbol >> (self.width - 1 - level) & 1).astype(bool)
            a, b = plane.rank1(low), plane.rank1(i)
            low, i = np.where(bit, self.zeros[level] + a, low - a), np.where(bit, self.zeros[level] + b, i - b)
        return i - low

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of symbol, which must exist."""
        low = np.zeros(1, np.int64)
        for level in range(self.width):
            ones = self.plane(level).rank1(low)
            low = self.zeros[level] + ones if symbol >> (self.width - 1 - level) & 1 else low - ones
        at = low + np.asarray(k, np.int64)
        for level in range(self.width - 1, -1, -1):
            one = bool(symbol >> (self.width - 1 - level) & 1)
            at = self.plane(level).select(at - self.zeros[level] if one else at, one)
        return at

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.n]))[0])

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of symbol."""
        return self.select(symbol, np.arange(self.count(symbol)))
