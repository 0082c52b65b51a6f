import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from lumenary.functions import dates, text, urls, vectors


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names))).first()[0]


def python_hash_form(value: str) -> str:
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().casefold()
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def test_hash_form_equals_the_python_rule(spark):
    for value in ("Straße e Ação!", "œuf ﬁn ½", "ÀÉÎõü ñ — “x”", "  ", "A B\tC", "x² ﬃ K Ǆ"):
        assert one(spark, text.hash_form, value) == python_hash_form(value), value


def test_content_hash(spark):
    got = one(spark, text.content_hash, "Olá", "Mundo é")
    assert got == hashlib.sha256(b"ola mundo e").hexdigest()


def test_words_and_clean(spark):
    rows = spark.createDataFrame([("a  b c",), ("   ",), (None,)], "t string").select(text.words("t"), text.clean("t")).collect()
    assert [tuple(r) for r in rows] == [(3, "a b c"), (0, ""), (0, "")]


def test_terms_split_hyphens_and_alphabetic_drops_them(spark):
    assert one(spark, text.terms, "Guarda-chuva 2x é") == ["guarda", "chuva", "x", "é"]
    row = spark.sql("SELECT array('guarda-chuva', 'Ab', 'x2') AS t").select(text.alphabetic("t")).first()[0]
    assert row == ["ab"]


def test_lists_blocks_phrases_categories(spark):
    assert one(spark, text.as_list, '["a","b"]') == ["a", "b"]
    assert one(spark, text.as_list, " a  b ") == ["a", "b"]
    held = spark.sql("SELECT sequence(1, 5) AS n").select(F.col("n").cast("array<string>").alias("t"))
    assert held.select(text.blocks("t", 2)).first()[0] == [["1", "2"], ["3", "4"], ["5"]]
    assert spark.sql("SELECT array() AS t").select(text.blocks(F.col("t").cast("array<string>"))).first()[0] == [[]]
    assert one(spark, lambda c: text.phrase_count(c, "a b"), " a b a b ") == 1
    assert one(spark, text.primary_category, "Sport , News") == "Sport"
    assert one(spark, text.primary_category, " ") == "Sem categoria"


def test_dates(spark):
    rows = [("2026-11-21T23:30:00-03:00",), ("2026-11-21T10:00:00",), ("2026-11-21T10:00:00Z",), ("never",)]
    got = spark.createDataFrame(rows, "d string").select(dates.local_day(F.col("d")), dates.utc_day(F.col("d"))).collect()
    assert [(str(a), str(b)) for a, b in got] == [("2026-11-21", "2026-11-22"), ("2026-11-21", "2026-11-21"), ("2026-11-21", "2026-11-21"), ("None", "None")]


def test_urls(spark):
    cases = {
        "https://www.x.org/a-story/": True, "https://x.org/category/": False, "https://x.org/a/b/": False, "https://y.org/a/": False,
        "https://x.org/photo.JPG": False, "https://x.org/": False, "https://x.org/wp-login/": False,
    }
    for url, expected in cases.items():
        assert one(spark, lambda c: urls.is_article(c, "x.org"), url) is expected, url
    assert one(spark, urls.canonical, "https://x.org/a//#top") == "https://x.org/a/"
    assert one(spark, lambda p: urls.listing("https://x.org/", p), 3) == "https://x.org/?page=3"


def test_relevance(spark):
    a, z = [1.0, 2.0], [0.0, 0.0]
    for metric in vectors.METRICS:
        assert abs(one(spark, lambda x, y: vectors.relevance(x, y, metric), a, a) - 1) < 1e-12
    assert one(spark, lambda x, y: vectors.relevance(x, y, "cosine"), a, z) == 0


def test_texts_are_hashed_in_batches_as_they_are_folded(spark):
    odd = [None, "", "ÀÉ ﬁn Ǆ ½ ﬃ", "① ㈠ 𝐀 ㎏ ﬗ ｟ x", "a\x00b\x1c\x85\xa0c", "İSTANBUL ß ﬀ ℀ ｆｕｌｌ", "é" * 3000 + "①", "é 中文 😀 K Å"]
    odd += ["".join(map(chr, range(k, min(k + 500, 0x110000)))) for k in [*range(1, 0xD700, 500), *range(0xE000, 0x11000, 500), 0x1D400, 0x1F100]]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, t string")
    got = rows.select(text.content_hash("t", F.lit("Ção")).alias("a"), F.sha2(text.hash_form(F.concat(F.coalesce("t", F.lit("")), F.lit(" Ção"))), 256).alias("b"))
    assert [r["a"] for r in got.collect()] == [r["b"] for r in got.collect()]
    explained = got.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in explained
