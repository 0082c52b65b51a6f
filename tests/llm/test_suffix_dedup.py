import random

import numpy as np
import pytest

from lumenary.llm import suffix_dedup
from lumenary.llm.chunks import Chunk, chunked, temporary_chunks


def brute(rows, length):
    least = {}
    for doc, data in rows:
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if least[data[k : k + length]] < doc:
                gone[k : k + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if len(data) else 0
        out.append((doc, len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return sorted(out)


def texts(seed=5, n=250):
    random.seed(seed)
    base = ["".join(random.choice("ab") for _ in range(random.randint(0, 200))) for _ in range(30)]
    base += ["a" * 300, "ab" * 90, "", "é" * 60]
    return ["".join(random.choice(base)[random.randint(0, 30) :] for _ in range(random.randint(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("length,trigger,hot", [(50, None, 1 << 30), (12, 5, 3), (8, 1, 1 << 30), (50, None, 0)])
def test_equals_brute_force(spark, corpus, length, trigger, hot):
    rows = list(enumerate(texts()))
    rows += [(7, "a" * 120), (7, rows[7][1])]  # repeated ids
    df = corpus([(i, t or None) for i, t in rows]).repartition(5)
    got = suffix_dedup.remove_repeats(df, length, trigger, hot=hot).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == brute(
        [(i, t.encode()) for i, t in rows], length
    )


def test_slices_do_not_matter(monkeypatch):
    data = np.frombuffer("".join(texts(3, 60)).encode(), np.uint8)
    chunk = Chunk.__new__(Chunk)
    chunk.data, chunk.ends, chunk.doc_ids = data, np.array([1000, 1000, 5000, len(data)]), np.arange(4)
    whole = suffix_dedup.Parse(chunk, 50, 32)
    monkeypatch.setattr(suffix_dedup, "SLICE", 777)
    cut = suffix_dedup.Parse(chunk, 50, 32)
    runs = lambda p: sorted((s, a, d, h) for a, f, l, d, h in zip(p.at, p.first, p.last, p.doc, p.hashed) for s in range(f, l + 1))  # noqa: E731, E741
    assert runs(whole) == runs(cut)


def test_empty_table_and_empty_texts(spark, corpus):
    assert suffix_dedup.remove_repeats(corpus([]), 50).count() == 0
    got = suffix_dedup.remove_repeats(corpus([(1, None), (2, ""), (None, "x" * 60), (3, "x" * 60)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 60)]


def test_bad_lengths():
    with pytest.raises(ValueError):
        suffix_dedup._pass(None, 20, 20, None, None)


def test_without_repeats_keeps_columns_and_whole_characters(spark, corpus):
    shared = "é" * 40 + "x"
    df = corpus([(1, "start " + shared), (2, "öther " + shared + " end"), (3, shared), (4, None)])
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df, 51).collect()}
    assert set(got) == {1, 2, 4} and got[4]["text"] is None and got[1]["text"] == "start " + shared
    assert got[2]["text"].startswith("öther") and got[2]["text"].endswith(" end") and got[2]["chunk"] == 2


def test_chunks_hold_every_document(spark, corpus):
    rows = [(i, "t" * (i % 7) * 100) for i in range(200)]
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("chunks_")}
    before = names()
    with temporary_chunks(spark):
        table = chunked(corpus(rows), size=3000, whole=True)
        chunks = [Chunk(r["doc_ids"], r["ends"], r["texts"]) for r in table.collect()]
        with temporary_chunks(spark):
            chunked(corpus(rows)).count()
        assert table.count() == len(chunks)  # another's end drops its own alone
    assert sorted((int(d), c.text(k).decode()) for c in chunks for k, d in enumerate(c.doc_ids)) == rows
    assert names() == before


def test_clashing_names(spark, corpus):
    from lumenary.llm.ngram_join import one_of_each

    text = " ".join(f"w{k}" for k in range(40))
    df = corpus([(1, text), (2, text), (3, None)]).selectExpr("*", "doc_id AS __known", "doc_id + 1 AS __text", "doc_id AS __id", "'x' AS `0`")
    with temporary_chunks(spark):
        assert sorted(r["__text"] for r in one_of_each(df).collect()) == [2, 4]
        assert sorted((r["__known"], r["text"]) for r in suffix_dedup.without_repeats(df, 50).collect() if r["text"]) == [(1, text)]
