"""Cutting text into the pieces that a vocabulary's pattern names."""

from __future__ import annotations

import re
from collections.abc import Callable

# The patterns of the public vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters up to U+024F.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The same patterns for text of those letters, where ``re``'s classes say the same and are faster.
_LATIN = {
    WORD_PATTERN: rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTERS}0-9]+",
    BYTE_PATTERN: rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+",
}
#: Other letters, numbers that are no digits, and separators that only ``re`` takes as white space.
_OTHER = re.compile("[\x1c-\x1f²³¹¼½¾ɐ-\U0010ffff]").search


def piece_cutter(pattern: str) -> Callable[[str], list[str]]:
    """Function from a text to its pieces."""
    import regex

    full = regex.compile(pattern).findall
    if pattern not in _LATIN:
        return full
    latin = re.compile(_LATIN[pattern]).findall

    def cut(text: str) -> list[str]:
        if text.isascii():  # then a few searches for single characters do
            odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        else:
            odd = _OTHER(text)
        return full(text) if odd else latin(text)

    return cut
