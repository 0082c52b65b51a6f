import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenary.llm import bpe, token_files
from lumenary.llm.common import vocabulary
from lumenary.llm.elias_fano import EliasFano
from lumenary.llm.packing import SumOfSquares, pack
from lumenary.llm.pieces import BYTE_PATTERN
from lumenary.llm.tokenizing import PieceTokenizer, piece_tokenizer

RANKS, WORDS, BYTES = (vocabulary(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = " \n\t\r\x0b\x1c\x85\xa0abAB01é'ß.,!?-́İΣſ²日_"
ODD = st.text(alphabet=ALPHABET + "<|endoftext|>", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=4))
@pytest.mark.parametrize("path,spaced", [(WORDS, True), (BYTES, False)])
def test_piece_ids_equal_the_library(path, spaced, texts):
    own = piece_tokenizer(path, spaced)
    expected = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.ids(texts)] == expected


def test_small_memo_changes_nothing():
    own = PieceTokenizer(BYTES, False, most=5)
    texts = [f"word{k % 7} and more {k}" for k in range(40)]
    for text in texts:
        assert own.ids([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_merges_equal_the_library():
    random.seed(2)
    own, other = bpe.codec(RANKS, BYTE_PATTERN), encoding()
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, "".join(random.choice("abcd") for _ in range(9000)), "<|endoftext|>"]
    assert [x.tolist() for x in own.encode(texts)] == [other.encode_ordinary(t) for t in texts]


def test_bpe_round_trip(spark, corpus):
    rows = [(1, "héllo  wörld"), (2, None), (3, ""), (1, "héllo  wörld"), (4, "x" * 50_000), (None, "日本\n")]
    got = bpe.decode(bpe.encode(corpus(rows), RANKS, BYTE_PATTERN), RANKS, BYTE_PATTERN).collect()
    assert sorted(((r["doc_id"] or 0), bytes(r["decoded"]).decode()) for r in got) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.encode(corpus([]), RANKS, BYTE_PATTERN).count() == 0


@given(st.lists(st.integers(0, 5000), max_size=900), st.integers(0, 10))
def test_elias_fano(values, room):
    values = sorted(values)
    held = EliasFano.of(np.array(values, np.int64), (values[-1] if values else 0) + 1 + room)
    back, size = EliasFano.from_bytes(memoryview(held.to_bytes() + b"rest"))
    assert back.all().tolist() == values and size == len(held.to_bytes())
    assert [back[i] for i in range(len(values))] == values


def test_token_files(spark, corpus):
    rows = [(k * 3 % 101, f"text {k} " * (k % 9)) for k in range(101)] + [(500, None), (501, "y" * 20_000), (None, "none"), (7, "again")]
    got = token_files.round_trip(corpus(rows).repartition(3), BYTES, spaced=False, end_id=0, segment_bytes=300).collect()
    own = piece_tokenizer(BYTES, False)
    ids = lambda t: own.ids([t or ""])[0].tobytes() + b"\0\0\0\0"
    expected, start = [], 0
    for doc, data in sorted(((-1 if i is None else i, ids(t)[:].hex()) for i, t in rows), key=lambda x: (x[0], np.frombuffer(bytes.fromhex(x[1]), "<u4").astype("<u2").tobytes())):
        data = bytes.fromhex(data)
        expected.append((doc, start, zlib.crc32(data)))
        start += len(data) // 4
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in got) == sorted(expected)
    assert token_files.round_trip(corpus([]), BYTES, spaced=False, end_id=0).count() == 0


@given(st.lists(st.integers(1, 40), max_size=120))
def test_windows_hold_every_id_once(lengths):
    packer, windows = SumOfSquares(16), []
    data = [np.arange(n, dtype="<u4").tobytes() for n in lengths]
    for doc, ids in enumerate(data):
        windows += packer.add(doc, ids)
    windows += packer.close()
    back = {}
    for k, pieces in enumerate(windows):
        size = sum(len(p.ids) // 4 for p in pieces)
        assert size == 16 or (k == len(windows) - 1 and 0 < size < 16)
        for p in pieces:
            back.setdefault(p.doc, []).append((p.start, p.ids))
    assert [b"".join(x for _, x in sorted(back[d])) for d in range(len(data))] == data


def test_the_rule_prefers_the_level_of_least_squares():
    packer = SumOfSquares(10)
    list(packer.add(0, b"\0" * 4 * 6))
    assert packer.level(4) == 6  # a full window costs nothing
    assert packer.level(3) == 6 or packer.level(3) == 0
    brute = lambda size: min((sum((packer.counts + d)[:10] ** 2), -h) for h in range(10) if h == 0 or packer.counts[h] for d in [shift(packer, h, size)] if h + size <= 10)
    for size in range(1, 10):
        level = packer.level(size)
        assert sum((packer.counts + shift(packer, level, size))[:10] ** 2) == brute(size)[0]


def shift(packer, level, size):
    out = np.zeros_like(packer.counts)
    if level:
        out[level] -= 1
    if level + size < packer.window:
        out[level + size] += 1
    return out


def test_pack(spark, corpus):
    rows = [(1, "a few words"), (2, None), (3, ""), (4, "long text " * 3000), (None, "x"), (1, "a few words")]
    got = pack(corpus(rows).coalesce(1), WORDS, spaced=True, end_id=2, window=64).collect()
    assert sorted(r["doc_id"] or 0 for r in got if r["start"] == 0) == [0, 1, 1, 2, 3, 4]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], len(r["ids"]) // 4))
    for pieces in by.values():
        at = 0
        for offset, length, n in sorted(pieces):
            assert offset == at and length == n
            at += length
    assert sum(sum(p[1] for p in x) < 64 for x in by.values()) <= 1
    assert pack(corpus([]), WORDS, spaced=True, end_id=2).count() == 0


def test_digest_of_ids_is_of_decimal_numbers(spark, corpus):
    from lumenary.llm.queries import F

    row = bpe.encode(corpus([(1, "hello")]), RANKS, BYTE_PATTERN).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)).first()
    assert row[0] == hashlib.sha256(",".join(map(str, encoding().encode_ordinary("hello"))).encode()).hexdigest()
