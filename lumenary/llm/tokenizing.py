"""Token ids of whole texts by a ``tokenizers`` file, encoding each distinct piece once.

Both kinds of tokenizer used here cut a text into pieces before any merge, so the ids of a text
are the ids of its pieces in a row. Known pieces come from a table; new ones go to the
library's model.

* ``spaced``: white space is dropped by the tokenizer, letters become lower case (word-end
  vocabularies). A text in which lower case or composition could move a piece's border goes to
  the library whole.
* otherwise: byte-level vocabularies, where a piece may begin with one space.

A text that holds the string of one of the file's added tokens goes to the library whole, too,
which takes such strings as those tokens unless ``plain`` says that they are ordinary text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from lumenary.llm.common import kept_in_worker, without_collector
from lumenary.llm.piece_table import TextCoder
from lumenary.llm.pieces import BYTE_PATTERN, WORD_PATTERN

@lru_cache(maxsize=1)
def byte_letters() -> np.ndarray:
    """Code point of the letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, other bytes for U+0100 and on.
    """
    shown = np.zeros(256, bool)
    for a, b in (("!", "~"), ("¡", "¬"), ("®", "ÿ")):
        shown[ord(a) : ord(b) + 1] = True
    return np.where(shown, np.arange(256), 255 + np.cumsum(~shown)).astype("<u4")


class PieceTokenizer:
    """``ids(texts)``: for each text its ids as an array of unsigned 32-bit numbers."""

    def __init__(self, path: str, spaced: bool, most: int, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.spaced = spaced
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in added if not (plain and token.special)]
        self.coder = TextCoder(WORD_PATTERN if spaced else BYTE_PATTERN, self._learn, most, self._prepare, self._whole)
        self.ids = without_collector(self.coder.ids)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _prepare(self, text: str) -> str | None:
        """The text that is cut; None where added tokens, lower case or composition could move borders."""
        for content in self.added:
            if content in text:
                return None
        if not self.spaced:
            return text
        if not text.isascii() and ("İ" in text or "Σ" in text or not unicodedata.is_normalized("NFC", text)):
            return None
        return text.lower()

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, from the letters of their bytes."""
        ends = np.cumsum(lengths + 1)
        letters = byte_letters()[data[np.repeat(starts - (ends - lengths - 1), lengths + 1) + np.arange(ends[-1])]]
        letters[ends - 1] = 0x20  # a blank stands for no byte
        flat: list[int] = []
        counts = []
        for piece in letters[:-1].tobytes().decode("utf-32-le").split(" "):
            found = self.model.tokenize(piece)
            flat += [token.id for token in found]
            counts.append(len(found))
        return np.array(flat, np.uint32), np.array(counts, np.int64)


@kept_in_worker
@lru_cache(maxsize=2)
def piece_tokenizer(path: str, spaced: bool, most: int = 400_000, plain: bool = False) -> PieceTokenizer:
    """One tokenizer for each worker process and file; ``most`` pieces are remembered."""
    return PieceTokenizer(path, spaced, most, plain)
