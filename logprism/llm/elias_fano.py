"""Elias-Fano code of a non-decreasing sequence, with select."""

from __future__ import annotations

import numpy as np

EVERY = 256  # one in so many set bits has its place noted
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """n numbers below a bound in about n * (2 + log2(bound / n)) bits.

    The low bits of each number stand side by side; the high bits are in unary, a set
    bit per number. ``select`` finds one number by the noted place before it, without
    decoding the rest.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.marks = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[::EVERY].copy() if n else np.zeros(0, np.int64)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = values.size
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, self.low.size, self.high.size], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[EliasFano, int]:
        """The sequence and how many bytes it took."""
        n, low_bits, low, high = (int(x) for x in np.frombuffer(data, "<u8", 4))
        end = 32 + low + high
        return cls(n, low_bits, data[32:32 + low], data[32 + low:end]), end

    def _place(self, i: int) -> int:
        """Where the i-th set bit is."""
        place = int(self.marks[i // EVERY])
        left = i % EVERY
        byte, bit = divmod(place, 8)
        left += int(ONES[self.high[byte] & ((1 << bit) - 1)])  # set bits before the noted one
        while left >= ONES[self.high[byte]]:
            left -= int(ONES[self.high[byte]])
            byte += 1
        return byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte:byte + 1], bitorder="little"))[left])

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        low = 0
        for j in range(self.low_bits):
            k = i * self.low_bits + j
            low |= int(self.low[k >> 3] >> (k & 7) & 1) << j
        return (self._place(i) - i) << self.low_bits | low

    def part(self, start: int, end: int) -> np.ndarray:
        """Numbers ``start`` to ``end``, of which only these are decoded: two selects find their bits."""
        if end <= start:
            return np.zeros(0, np.int64)
        first, last = self._place(start), self._place(end - 1)
        byte = first >> 3
        places = np.flatnonzero(np.unpackbits(self.high[byte:(last >> 3) + 1], bitorder="little")) + 8 * byte
        highs = places[np.searchsorted(places, first):][:end - start] - np.arange(start, end)
        if not self.low_bits:
            return highs
        at = start * self.low_bits
        bits = np.unpackbits(self.low[at >> 3:-(-end * self.low_bits // 8)], bitorder="little")[at & 7:][:(end - start) * self.low_bits]
        return (highs << self.low_bits) | (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def all(self) -> np.ndarray:
        return self.part(0, self.n)
