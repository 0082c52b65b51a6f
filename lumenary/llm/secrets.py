"""Secret scans: patterns, and strings that a primed zstandard coder finds new.

Three kinds of span come from patterns. A fourth comes from compression: a long run of key
characters that stands near a sensitive word and not wholly in a pattern's span is a candidate.
The text around it is compressed with and without it by a coder primed with a dictionary: key
words of code, and the identifiers that most documents of the corpus have. What the candidate
adds, for each of its bytes, says how new it is. A random key cannot be compressed below the entropy of its alphabet, while a
path, a word list or a repeated identifier nearly vanishes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenary.llm.common import text_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SENSITIVE = re.compile(r"key|secret|token|passw|credential|auth|bearer|private|signature|cert", re.IGNORECASE | re.ASCII)

#: Whole words of two parts or more, shorter than any candidate, so that no key gets into a dictionary.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z_]{4,19}(?![A-Za-z0-9_]))(?:[A-Za-z]+_[A-Za-z_]*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])")

#: What the coder knows of any corpus beforehand.
IDENTIFIERS = """
import from return class def function public private static final const let var void int string boolean float
self this null none true false if else elif for while try except catch finally raise throw new delete async await
config settings environment variable value default option parameter argument request response header cookie session
user username password passwd secret token access refresh bearer authorization authentication credential api_key
apikey client_id client_secret private_key public_key signature certificate database connection host port address
service account project bucket region endpoint version message status error warning debug info logger name path file
directory index count length size offset start end first last next previous get set add remove update create read
write open close load save parse format encode decode encrypt decrypt hash digest base64 sha256 https http www com org
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx example placeholder test
"""


class Scanner:
    """Spans ``(start, kind, end)`` of a text, in code points, by start and then kind.

    ``near``: code points before a candidate in which a sensitive word must stand; ``around``:
    code points on either side that its bytes are measured against; ``least``: compressed bytes
    for each byte of a candidate from which it is reported; ``known``: identifiers of the corpus.
    """

    def __init__(self, known: tuple[str, ...] = (), near: int = 48, around: int = 256, least: float = 0.6):
        self.near, self.around, self.least = near, around, least
        # the commonest last, where references are shortest
        words = "\n".join([*reversed(known), IDENTIFIERS])
        known = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=19)
        self.coder = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False)

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds to its surroundings, for each of its own."""
        size = lambda text: len(self.coder.compress(text.encode("utf-8", "surrogatepass")))
        rest = f"{before}\n{after}\n"
        return (size(rest + candidate) - size(rest)) / max(1, len(candidate))

    def patterns(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        lower = text.lower()
        if any(name in lower for name in _NAMES):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = self.patterns(text)
        new = []
        for m in _RUN.finditer(text):
            a, b = m.span()
            word = m[0]
            if any(x <= a and b <= y for x, _, y in found):
                continue
            if not _SENSITIVE.search(text, max(0, a - self.near), a):
                continue
            if self.novelty(text[max(0, a - self.around) : a], word, text[b : b + self.around]) >= self.least:
                new.append((a, 3, b))
        return sorted(found + new)


def identifiers(docs: DataFrame, most: int = 2000, text_col: str = "text") -> tuple[str, ...]:
    """The ``most`` identifiers that most rows of ``docs`` have, by falling count and then by name.

    Identifiers are whole words of 4 to 19 letters and underscores in two parts or more; every
    whole text counts. A null or empty text has none; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, 0):
            seen = Counter(word for text in texts for word in set(_IDENTIFIER.findall(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return tuple(row["word"] for row in counts.orderBy(F.desc("n"), "word").limit(most).collect())


@lru_cache(maxsize=1)
def _scanner(known: tuple[str, ...], **options) -> Scanner:
    return Scanner(known, **options)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[str, ...] | None = None, **options) -> DataFrame:
    """``doc_id, spans``: of each whole text, an array of ``kind, start, stop`` in code points.

    A null or empty text has no spans; a null id stays null; repeated rows are scanned each for
    itself; an empty table gives no rows. Overlapping spans of different kinds all stay, those of
    one start by kind. Other columns are not read. ``known``: identifiers of the corpus, by default
    those of ``docs``; ``options`` are the Scanner's.
    """
    known = identifiers(docs, text_col=text_col) if known is None else known
    schema = StructType.fromDDL("doc_id long, spans array<struct<kind:string,start:long,stop:long>>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(known, **options)
        for part, texts in text_batches(batches, "text"):
            rows = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in scanner.spans(text)] for text in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, arrow.field("spans").type)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", known: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``; spans that overlap become one.

    All columns and rows stay, repeated ones too; a null text stays null and an empty one empty;
    an empty table gives no rows. ``known`` as for ``scan``.
    """
    known = identifiers(docs, text_col=text_col) if known is None else known
    schema = docs.schema
    arrow = to_arrow_schema(schema)
    place = docs.columns.index(text_col)

    def hidden(text: str, scanner: Scanner) -> str:
        out, at = [], 0
        for a, _, b in scanner.spans(text):
            if a > at or not out:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(known)
        for part, texts in text_batches(batches, place):
            there = part.column(place).is_valid().to_pylist()
            new = pa.array([hidden(x, scanner) if k else None for x, k in zip(texts, there)], arrow.field(place).type)
            columns = [new if k == place else c.cast(arrow.field(k).type) for k, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)
