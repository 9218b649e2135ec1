"""Elias-Fano coding of a non-decreasing sequence, with select.

n values below u take about n * (2 + log2(u / n)) bits: the low bits of each
value are packed side by side, the high parts are coded in unary in a bit
vector where the i-th set bit, at position high(i) + i, belongs to value i.  A
directory of every ``STEP``-th set bit lets ``select`` read a few words only,
so no table of 64-bit offsets exists.
"""

from __future__ import annotations

import struct

import numpy as np

#: One directory entry for so many set bits.
STEP = 256
HEAD = struct.Struct("<QQBxxxxxxxQQQ")  # n, universe, low bits, bytes of the low part, the high part and the directory
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode(values: np.ndarray, universe: int) -> bytes:
    """Values are non-decreasing and in 0 .. universe."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    if low:
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lower = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    else:
        lower = b""
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    flags = np.zeros((int(universe) >> low) + n + 1, dtype=np.uint8)
    flags[ones] = 1
    upper = np.packbits(flags, bitorder="little").tobytes()
    directory = ones[::STEP].astype("<u4" if len(flags) < 1 << 32 else "<u8").tobytes()
    return HEAD.pack(n, universe, low, len(lower), len(upper), len(directory)) + lower + upper + directory


class Sequence:
    """Reads an encoded sequence without unpacking it as a whole."""

    def __init__(self, data, at: int = 0):
        self.n, self.universe, self.low, a, b, c = HEAD.unpack_from(data, at)
        at += HEAD.size
        self._lower = np.frombuffer(data, np.uint8, a, at)
        self._upper = np.frombuffer(data, np.uint8, b, at + a)
        wide = (self.universe >> self.low) + self.n + 1 >= 1 << 32
        self._directory = np.frombuffer(data, "<u8" if wide else "<u4", c // (8 if wide else 4), at + a + b)
        self.end = at + a + b + c

    def _select1(self, i: int) -> int:
        """The position of the i-th set bit of the high part."""
        position, rest = int(self._directory[i // STEP]), i % STEP
        if not rest:
            return position
        byte = position // 8
        # set bits after ``position`` in its own byte
        head = int(self._upper[byte]) >> (position % 8 + 1)
        have = bin(head).count("1")
        if rest <= have:
            base, word = position + 1, head
        else:
            rest -= have
            byte += 1
            while True:
                counts = np.cumsum(_POP[self._upper[byte : byte + 64]], dtype=np.int64)
                k = int(np.searchsorted(counts, rest))
                if k < len(counts):
                    break
                rest -= int(counts[-1])
                byte += 64
            rest -= int(counts[k - 1]) if k else 0
            base, word = (byte + k) * 8, int(self._upper[byte + k])
        for bit in range(8):
            rest -= word >> bit & 1
            if not rest:
                return base + bit
        raise IndexError(i)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = self._select1(i) - i
        if not self.low:
            return value
        begin = i * self.low
        word = int.from_bytes(self._lower[begin // 8 : (begin + self.low + 7) // 8].tobytes(), "little")
        return value << self.low | word >> begin % 8 & (1 << self.low) - 1

    def values(self, at: int, to: int) -> np.ndarray:
        """Values ``at`` to ``to`` - 1, decoded in one pass over their bits."""
        if at >= to:
            return np.zeros(0, np.int64)
        first, last = self._select1(at), self._select1(to - 1)
        flags = np.unpackbits(self._upper[first // 8 : last // 8 + 1], bitorder="little")
        ones = np.flatnonzero(flags[first % 8 :]) + first
        out = ones[: to - at] - np.arange(at, to)
        if not self.low:
            return out
        begin, end = at * self.low, to * self.low
        bits = np.unpackbits(self._lower[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 :][: end - begin]
        lows = bits.reshape(-1, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out << self.low | lows
