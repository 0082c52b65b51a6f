import random

import numpy as np

import corpus_pipeline
from lumenary.llm import queries
from lumenary.llm.common import vocabulary
from lumenary.llm.tokenizing import piece_tokenizer


def test_stages_follow_each_other(spark, tmp_path):
    """Planted cases go, clean documents stay, and the windows hold the tokens of what was kept."""
    random.seed(11)
    prose = lambda n: " ".join(f"{random.choice('abcdefg')}{random.randrange(3000)}x" for _ in range(n))
    rows = {k: prose(120) for k in range(300)}
    labels = []
    for k in range(300):
        if k % 4 == 0:
            rows[k] += " vile nasty awful"
        if k < 200:
            labels.append((k, 1, int(k % 4 == 0)))
    rows[401], rows[402] = rows[1], rows[2].replace("x ", "y ", 1)  # an exact and a near copy
    passage = prose(60)
    rows[403], rows[404] = f"{prose(90)} {passage} {prose(40)}", f"{prose(80)} {passage}"
    rows[405] = prose(30) + " api_key=abcdef123456"
    rows[406], rows[407] = None, ""
    folder = str(tmp_path / "sf")
    documents = [(k, t, "en", "s", len(t or "")) for k, t in rows.items()]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], folder).write.parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    for docs in kept[1:-1]:
        assert docs.columns == kept[0].columns
    ids = [{r["doc_id"] for r in docs.select("doc_id").collect()} for docs in kept]
    assert ids[1] == {k for k in rows if not (k < 300 and k % 4 == 0)}
    assert ids[1] - ids[2] == {401, 402} and ids[3] == ids[2]
    text = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    assert passage in text[403] and passage[20:-20] not in text[404] and "abcdef123456" not in text[405]
    assert text[406] is None and text[407] == "" and text[3] == rows[3]
    own = piece_tokenizer(vocabulary("word_bpe_49k.json"), True)
    pieces: dict = {}
    for r in kept[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {k: b"".join(x for _, x in sorted(p)) for k, p in pieces.items()} == {
        k: own.ids([t or ""])[0].tobytes() + np.array([2], "<u4").tobytes() for k, t in text.items()
    }


def test_queries_are_one_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "secrets", "packing"]


def stages(spark, folder, docs):
    """What every stage keeps of ``docs``, read again after each."""
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], folder).write.parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    return kept


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, no rows at all, repeated rows, a very long text, and columns with clashing names."""
    random.seed(3)
    words = lambda n: " ".join(f"w{random.randrange(9999)}" for _ in range(n))
    same = words(60)
    rows = [(1, same, "en"), (1, same, "en"), (None, words(40), None), (None, words(40), "de"), (5, None, None), (6, "", "en"), (6, "", "en"), (7, words(60_000), "en"), (8, "x", None)]
    shape = "doc_id long, text string, lang string"
    clash = ["chunk", "row", "__known", "__text", "__id", "kind", "digest", "node", "component", "salt", "p_toxic", "ids", "rest"]
    df = spark.createDataFrame(rows, shape).selectExpr("*", "length(text) AS n_chars", *[f"'c' AS `{c}`" for c in clash])
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (8, 0, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", df), ("none", df.filter("false"))):
        folder = str(tmp_path / name)
        labels.write.parquet(f"{folder}/labels.parquet")
        kept = stages(spark, folder, docs)
        assert all(k.columns == df.columns for k in kept[:-1])
        if name == "none":
            assert all(k.count() == 0 for k in kept)
            continue
        texts = sorted(r["text"] or "" for r in kept[4].collect())
        assert texts == sorted([same, rows[2][1], rows[3][1], "", "", "", rows[7][1], "x"]) or texts == sorted([same, rows[2][1], rows[3][1], "", "", "", rows[7][1]])
        assert {r["doc_id"] for r in kept[5].select("doc_id").distinct().collect()} >= {1, None, 5, 6, 7}


def test_run_leaves_only_its_result(spark, tmp_path):
    import os

    folder = str(tmp_path / "sf")
    spark.createDataFrame([(k, f"some words {k}", "en") for k in range(20)], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    found = corpus_pipeline.run(spark, folder)
    assert found.select("doc_id").distinct().count() == 20
    top = os.path.dirname(found.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert sorted(x for x in os.listdir(os.path.dirname(top)) if not x.startswith(".")) == ["packing"]
    assert {t.name for t in spark.catalog.listTables()} == before
