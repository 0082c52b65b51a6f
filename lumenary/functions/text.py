"""Column functions on text: folding, tokens, hashes, counts."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Unicode white space, and of letters.
SPACE, LETTERS = r"(?U)\s+", r"\p{L}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACE, " "))


def words(c: Column | str) -> Column:
    """How many runs of visible characters a text has; 0 for null."""
    text = clean(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("int")


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility decomposition has one ASCII letter, those letters, and longer ones.

    Derived from the Unicode database: decompose, drop what is not ASCII.
    """
    single, ascii_of, longer = [], [], []
    for code in [*range(0x80, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append(char)
            ascii_of.append(plain)
        elif len(plain) > 1:
            longer.append((char, plain))
    return "".join(single), "".join(ascii_of), longer


def fold(c: Column | str) -> Column:
    """Lower-case ASCII form: accents off, characters without an ASCII form dropped.

    Ligatures and other characters that stand for several letters are expanded only in texts that
    hold one, so plain texts take one ``translate``.
    """
    single, ascii_of, longer = fold_table()
    text = F.translate(F.coalesce(_col(c), F.lit("")), single, ascii_of)
    expanded = text
    for char, plain in longer:
        expanded = F.replace(expanded, F.lit(char), F.lit(plain))
    some = "[" + "".join(char for char, _ in longer) + "]"
    plain_text = F.coalesce(_col(c), F.lit(""))
    folded = F.regexp_replace(F.when(text.rlike(some), expanded).otherwise(text), r"[^\x00-\x7F]+", "")
    # ``translate`` looks every character up, so text that is ASCII already goes without it
    return F.lower(F.when(plain_text.rlike(r"[^\x00-\x7F]"), folded).otherwise(plain_text))


def hash_form(c: Column | str) -> Column:
    """Folded text, every run of other characters than letters and digits a space, trimmed."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def folder() -> Callable[[str], bytes]:
    """``fold`` as a function on one string, except for lower case: accents off, other characters dropped.

    Of what ``fold`` knows, the decomposition's ASCII letters are the folded form; characters
    outside those ranges are dropped before. It is made of values only, so that it can go to
    Python workers that cannot import this package.
    """
    unknown, normalize = re.compile("[\u2200-\ufaff\ufb07-\uff00\uff5f-\U0010ffff]"), unicodedata.normalize

    def ascii_of(value: str) -> bytes:
        if value.isascii():
            return value.encode()
        return normalize("NFKD", unknown.sub("", value)).encode("ascii", "ignore")

    return ascii_of


#: Values of an Arrow batch that are Python objects at once.
SLICE = 256


def content_hash(title: Column | str, content: Column | str) -> Column:
    """SHA-256 of the folded title and content (``hash_form`` of both).

    Texts are folded in Arrow batches: a whole text there takes a few passes in C, whereas the
    column functions look every character up.
    """
    plain, sha = folder(), hashlib.sha256
    kept = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

    @F.arrow_udf("string")
    def digest(titles: pa.Array, contents: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(titles), SLICE):
            for a, b in zip(titles.slice(at, SLICE).to_pylist(), contents.slice(at, SLICE).to_pylist()):
                found.append(sha(b" ".join(plain(f"{a or ''} {b or ''}").translate(kept).split())).hexdigest())
        return pa.array(found, pa.string())

    return digest(_col(title).cast("string"), _col(content).cast("string"))


def terms(c: Column | str, stopwords: list[str] | None = None) -> Column:
    """Letter runs in lower case, in order, repeated ones kept; without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(LETTERS), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stopwords)) if stopwords else found


def alphabetic(tokens: Column | str) -> Column:
    """Tokens of letters only, in lower case; others are dropped whole."""
    return F.filter(F.transform(_col(tokens), F.lower), lambda t: t.rlike(rf"^{LETTERS}$"))


def as_list(c: Column | str) -> Column:
    """A token list from a JSON array or from words between white space."""
    text = _col(c)
    split = F.filter(F.split(F.trim(text), SPACE), lambda t: t != "")
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), split, F.array().cast("array<string>"))


def blocks(tokens: Column | str, size: int = 254) -> Column:
    """A token list in blocks of ``size``; an empty list is one empty block."""
    held = _col(tokens)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(held) / size).cast("int") - 1), lambda k: F.slice(held, k * size + 1, size))
    return F.when(F.size(held) > 0, cut).otherwise(F.array(F.array().cast("array<string>")))


def primary_category(c: Column | str, missing: str = "Sem categoria") -> Column:
    """What stands before the first comma; ``missing`` where that is nothing."""
    return F.coalesce(F.nullif(F.trim(F.split_part(_col(c), F.lit(","), F.lit(1))), F.lit("")), F.lit(missing))


def plain_field(c: Column | str) -> Column:
    """Text without asterisks, underscores and backticks, white space collapsed."""
    return clean(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[*_`]", ""))


def source_numbers(c: Column | str, n: Column | int) -> Column:
    """Distinct numbers from 1 to n of an array, rising."""
    limit = n if isinstance(n, Column) else F.lit(n)
    return F.array_sort(F.array_distinct(F.filter(_col(c), lambda k: (k >= 1) & (k <= limit))))


def phrase_count(joined: Column, phrase: str) -> Column:
    """Occurrences of a phrase in space-delimited text, left to right, delimiters not shared."""
    return F.size(F.split(joined, f" {phrase} ")) - 1
