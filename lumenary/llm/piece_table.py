"""Many texts at once: cut into a vocabulary's pieces as one byte array, looked up in one table.

Texts of Latin letters are cut by array operations over their UTF-8 bytes, all others by the
pattern itself. A piece of up to ``KEY`` bytes is its own key (three 64-bit words and a length),
so the table of known pieces is exact and takes some fifty bytes for each; longer pieces are
worked out anew wherever they occur, so that what is remembered is bounded in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np

from lumenary.llm.hashing import mix
from lumenary.llm.pieces import BYTE_PATTERN, WORD_PATTERN, piece_cutter

#: Bytes of the longest piece that is remembered, and of the texts that are worked on at once.
KEY, STRIP = 24, 1 << 20

_EDGE, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
_EDGE_BYTE = 0xFF  # never in UTF-8
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[:128] = _OTHER
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[ord("0") : ord("9") + 1] = _NUMBER
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[_EDGE_BYTE] = _EDGE
#: What the arrays do not tell apart: other letters, numbers and white space than the ones above.
_ODD = re.compile("[\x1c-\x1f\x80-\xbf×÷ɐ-‏ -₫₭-\U0010ffff]").search
#: Words of one to eight bytes: which bits of a 64-bit word they fill.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: From bytes, starts and lengths of pieces to all their ids in a row and the number of each one's.
Learn = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def latin(text: str) -> bool:
    """Whether ``cut`` says of a text what the patterns say."""
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not _ODD(text)


def cut(data: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of latin texts that stand between edge bytes.

    By WORD_PATTERN where ``spaced`` (white space is no piece), else by BYTE_PATTERN.
    """
    kind = _KIND[data]
    marks = np.flatnonzero(data == 0xE2)  # punctuation of three bytes
    for k in range(3):
        kind[marks + k] = _OTHER
    start = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    quotes = np.flatnonzero(data[:-2] == 39)
    if spaced:
        start |= kind == _NUMBER
        quotes = quotes[kind[quotes - 1] != _OTHER]
    else:
        # the last of a run of white space goes on its own, or, a space, with what follows
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] > _SPACE))
        start[last] = True
        start[last[data[last] == 32] + 1] = False
        quotes = quotes[(kind[quotes - 1] != _OTHER) & (data[quotes - 1] != 32)]
    one, two = data[quotes + 1], data[quotes + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    start[quotes[short | long] + 1] = False
    start[quotes[short] + 2] = True
    start[quotes[long & ~short] + 3] = True
    starts = np.flatnonzero(start)
    lengths = np.diff(starts, append=len(data))
    keep = kind[starts] > (_SPACE if spaced else _EDGE)
    return starts[keep], lengths[keep]


class PieceTable:
    """Ids of pieces, those of short ones remembered, ``most`` at a time.

    Where there are too many, those that several batches had stay; what does not fit is worked out anew.
    """

    def __init__(self, learn: Learn, most: int):
        self.learn, self.most = learn, most
        self.bits = max(4, (2 * most - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((0, 3), np.uint64)
        self.sizes = np.zeros(0, np.uint8)
        self.hashes = np.zeros(0, np.uint64)
        self.again = np.zeros(0, bool)  # pieces that several batches had
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _keep(self, some: np.ndarray) -> None:
        """Forget all but the entries ``some``."""
        keys, sizes, hashes = self.keys[some], self.sizes[some], self.hashes[some]
        flat, counts = gather(self.flat, self.ends[some], self.ends[some + 1])
        self._clear()
        self._add(keys, sizes, hashes, flat, counts)

    def _add(self, keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = len(self.sizes)
        self.keys, self.sizes = np.concatenate((self.keys, keys)), np.concatenate((self.sizes, sizes))
        self.hashes = np.concatenate((self.hashes, hashes))
        self.again = np.concatenate((self.again, np.zeros(len(sizes), bool)))
        self.flat = np.concatenate((self.flat, flat))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))
        number = np.arange(n, n + len(sizes), dtype=np.int32)
        left, slot = number, self._slot(hashes)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)
        return number

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 where there is none."""
        out = np.full(len(sizes), -1, np.int64)
        left, slot = np.arange(len(sizes)), self._slot(hashes)
        while len(left):
            entry = self.slots[slot]
            held = entry >= 0
            left, slot, entry = left[held], slot[held], entry[held]
            same = (self.hashes[entry] == hashes[left]) & (self.sizes[entry] == sizes[left])
            same[same] = (self.keys[entry[same]] == keys[left[same]]).all(1)
            out[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and the number of each one's.

        ``data`` has KEY bytes beyond the last piece's start at least.
        """
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        short = lengths <= KEY
        at, size = starts[short], lengths[short]
        keys = np.stack([words[at + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(3)], axis=1)
        hashes = mix(mix(mix(keys[:, 0] + size.astype(np.uint64)) ^ keys[:, 1]) * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 2])
        sizes = size.astype(np.uint8)
        entry = self._find(keys, sizes, hashes)
        self.again[entry[entry >= 0]] = True
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            _, first, group = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            other = (keys[first][group] != keys[unknown]).any(1) | (sizes[first][group] != sizes[unknown])
            if other.any():  # two pieces of one hash: these are worked out like long ones
                entry[unknown[other]] = -2
            if len(self.sizes) + len(first) > self.most:
                held = entry >= 0
                kept = np.zeros(len(self.sizes), bool)
                kept[entry[held]] = True
                if np.count_nonzero(self.again) <= self.most // 2:
                    kept |= self.again
                to = np.cumsum(kept) - 1
                self._keep(np.flatnonzero(kept))
                entry[held] = to[entry[held]]
            first = first[: self.most - len(self.sizes)]  # the others are not remembered
            new = np.full(len(group), -1)
            new[: len(first)] = self._add(keys[first], sizes[first], hashes[first], *self.learn(data, at[first], size[first]))
            entry[unknown[~other]] = new[group[~other]]
        place = np.full(len(starts), -1, np.int64)
        place[short] = np.maximum(entry, -1)
        flat, ends = self.flat, self.ends
        rest = np.flatnonzero(place < 0)
        if len(rest):
            seen: dict[bytes, int] = {}
            number = [seen.setdefault(data[a : a + n].tobytes(), len(seen)) for a, n in zip(starts[rest].tolist(), lengths[rest].tolist())]
            once = rest[np.unique(number, return_index=True)[1]]
            more, counts = self.learn(data, starts[once], lengths[once])
            place[rest] = len(ends) - 1 + np.array(number)
            flat, ends = np.concatenate((flat, more)), np.concatenate((ends, ends[-1] + np.cumsum(counts)))
        return gather(flat, ends[place], ends[place + 1])


def gather(flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[a[i]:b[i]]`` for every i in a row, and their lengths."""
    counts = b - a
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(a - (ends - counts), counts) + np.arange(total)], counts


class TextCoder:
    """Ids of whole texts: ``ids(texts)`` gives an array of unsigned 32-bit numbers for each.

    ``prepare`` gives the text that is cut, or None where ``whole`` must be asked.
    """

    def __init__(self, pattern: str, learn: Learn, most: int, prepare: Callable[[str], str | None] = lambda text: text, whole: Callable[[str], np.ndarray] | None = None):
        self.spaced, self.known = pattern == WORD_PATTERN, pattern in (WORD_PATTERN, BYTE_PATTERN)
        self.cut = piece_cutter(pattern)
        self.table = PieceTable(learn, most)
        self.prepare, self.whole = prepare, whole

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        edge = bytes([_EDGE_BYTE])
        data = np.frombuffer(edge + edge.join(texts) + edge + bytes(KEY + 8), np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        starts, lengths = cut(data[: ends[-1] + 1], self.spaced)
        return self._texts(data, starts, lengths, np.searchsorted(starts, ends))

    def _texts(self, data, starts, lengths, last: np.ndarray) -> list[np.ndarray]:
        """Ids text by text; ``last``: pieces up to each text's end."""
        flat, counts = self.table.ids(data, starts, lengths)
        ends = np.concatenate(([0], np.cumsum(counts)))[last]
        return np.split(flat, ends[:-1])

    def _apart(self, text: str) -> np.ndarray:
        """Of one text, by the pattern."""
        pieces = [x.encode("utf-8", "surrogatepass") for x in self.cut(text)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces) + bytes(KEY + 8), np.uint8)
        return self._texts(data, np.cumsum(lengths) - lengths, lengths, np.array([len(pieces)]))[0]

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        for some in self._strips(texts, out):
            for k, found in zip((k for k, _ in some), self._together([x for _, x in some])):
                out[k] = found
        return out

    def _strips(self, texts: Sequence[str], out: list) -> Iterator[list[tuple[int, bytes]]]:
        """Numbered texts to be cut together; the others' ids are put into ``out``."""
        some, size = [], 0
        for k, text in enumerate(texts):
            ready = self.prepare(text)
            if ready is None:
                out[k] = self.whole(text)
            elif not (self.known and latin(ready)):
                out[k] = self._apart(ready)
            else:
                data = ready.encode()
                if some and size + len(data) > STRIP:
                    yield some
                    some, size = [], 0
                some.append((k, data))
                size += len(data)
        if some:
            yield some
