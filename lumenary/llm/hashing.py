"""Rolling hashes of many byte strings at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers that loses nothing."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, as many as were needed yet."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.full(size, _MULTIPLIER, np.uint64)
            self.down = np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_powers = _Powers()


class Rolling:
    """Hashes of substrings of one byte array: equal bytes have equal hashes, wherever they are."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = _powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters()[data] * self.up[:n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row and where each text ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(b"".join(texts), np.uint8), ends


def strips(ends: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Numbers of the first and past the last text of runs of about ``size`` bytes.

    Arrays over so many bytes stay in a core's cache; a longer text is a run of its own.
    """
    a, n = 0, len(ends)
    while a < n:
        start = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, start + size, side="right")))
        yield a, min(b, n)
        a = b


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a rising array, and where each one's run begins, with the end."""
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return values[new], np.append(new, len(values))


def words(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that ``inside`` marks, and the number of each one's text.

    A run does not reach from one text into the next.
    """
    marked = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.concatenate(([False], marked[:-1])) & ~edge[:-1]
    after = np.concatenate((marked[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(marked & ~before)
    stops = np.flatnonzero(marked & ~after) + 1
    return starts, stops, np.searchsorted(ends, starts, side="right")


#: Words of one to eight bytes: which bits of a 64-bit number they fill.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Of short runs of bytes: words of up to 24 bytes from all their bytes at once, others by xxh3.

    Unlike a rolling hash, whose modulus is a power of two, neither has long strings that are
    known to collide.
    """
    import xxhash

    padded = np.concatenate((data, np.zeros(32, np.uint8)))
    bits = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = stops - starts
    out = size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    for k in range(3):  # starts + 16 may be beyond the data for short words; their mask is empty
        filled = _FILLED[np.clip(size - 8 * k, 0, 8)]
        out = mix((out ^ (bits[starts + 8 * k] & filled)) * _U(_MULTIPLIER))
    for k in np.flatnonzero(size > 24).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : stops[k]].tobytes(), 0x51ED2701)
    return out
