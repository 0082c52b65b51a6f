"""Elias-Fano coded rising numbers, with a select structure."""

from __future__ import annotations

import numpy as np

#: Ones between two sampled positions of the upper bits.
SAMPLE = 64


class EliasFano:
    """Numbers that never fall, each below ``bound``, in about 2 + log2(bound / n) bits each.

    ``low`` bits of every number stand packed one after the other; the rest is a row of bits in
    which number i with upper part h is the one at place h + i. ``samples`` hold the places of
    every SAMPLE-th one, are stored with the numbers, and let ``select`` scan a few bytes only.
    """

    def __init__(self, n: int, low: int, lower: bytes, upper: bytes, samples: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.samples = n, low, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        low = max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low)) & 1
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        upper = np.zeros((max(bound, 1) >> low) + n + 1, np.uint8)
        upper[(values >> low) + np.arange(n)] = 1
        samples = np.flatnonzero(upper)[::SAMPLE].astype("<u8")
        return cls(n, low, lower, np.packbits(upper, bitorder="little").tobytes(), samples)

    def __getitem__(self, i: int) -> int:
        """Number i by select: the place of the (i+1)-th one, less i, with its lower bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = self.upper[byte] >> (at % 8)
        base = at
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            base, word = 8 * byte, self.upper[byte]
        for _ in range(left):
            word &= word - 1
        place = base + (word & -word).bit_length() - 1
        start = i * self.low
        field = int.from_bytes(self.lower[start // 8 : (start + self.low + 7) // 8], "little") >> (start % 8)
        return (place - i) << self.low | field & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """Every number, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), bitorder="little")[: self.n * self.low]
        rest = (bits.reshape(self.n, self.low).astype(np.int64) << np.arange(self.low)).sum(1) if self.low else 0
        return ((ones - np.arange(self.n)) << self.low) + rest

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low, len(self.lower), len(self.upper)], "<u8").tobytes()
        return head + self.lower + self.upper + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The numbers at the start of ``data`` and how many bytes they took."""
        n, low, a, b = np.frombuffer(data[:32], "<u8").tolist()
        c, d = 32 + a + b, 32 + a + b + 8 * -(-n // SAMPLE)
        return cls(n, low, bytes(data[32 : 32 + a]), bytes(data[32 + a : c]), np.frombuffer(data[c:d], "<u8")), d
