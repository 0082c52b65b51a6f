import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenary.llm.components import components
from lumenary.llm.ngram_join import _need, jaccard_components, linked, one_of_each, shingles
from lumenary.llm.hashing import join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = {i: own_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def edited(words, changes):
    words = list(words)
    for _ in range(changes):
        words[random.randrange(len(words))] = f"w{random.randrange(9999)}"
    return " ".join(words)


@pytest.mark.parametrize("n,percent", [(4, 85), (1, 60)])
def test_equals_brute_force(spark, corpus, n, percent):
    random.seed(n)
    base = [[f"w{random.randrange(300)}" for _ in range(random.randint(3, 120))] for _ in range(12)]
    common = [f"c{k}" for k in range(40)]
    rows = [(i, edited(random.choice(base), random.randint(0, 4))) for i in range(150)]
    rows += [(200 + i, " ".join(common) + " " + edited(base[0][:9] or ["x"], i % 5)) for i in range(60)]
    rows += [(300, ""), (301, None), (302, " \t "), (303, "one two"), (304, "ONE two"), (305, "one\x0btwo"), (306, "one two"), (307, "a " * 4000)]
    got = jaccard_components(corpus(rows).repartition(4), n, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, n, percent)


def test_large_group_of_near_copies(spark, corpus):
    random.seed(1)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, edited(words, 2)) for i in range(400)]
    got = jaccard_components(corpus(rows), 4, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 4, 85)


def test_empty_table(spark, corpus):
    assert jaccard_components(corpus([])).count() == 0
    assert one_of_each(corpus([])).count() == 0


def test_one_of_each_keeps_rows_as_they_were(spark, corpus):
    text = " ".join(f"w{k}" for k in range(60))
    df = corpus([(5, text), (3, text + " more"), (9, "other words here and there"), (7, ""), (8, None), (9, "other words here and there")])
    got = sorted((r["doc_id"], r["text"], r["row"]) for r in one_of_each(df).collect() if r["text"] is not None)
    assert got == [(3, text + " more", 3), (7, "", 7), (9, "other words here and there", 9)]


def test_ids_that_are_null_or_repeated_join_nothing(spark, corpus):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    ids = [None] * 20 + [4] * 20 + list(range(100, 120))
    rows = [(i, text(k)) for k, i in enumerate(ids)]
    rows += [(None, text(0) + " more"), (4, text(20)), (7, text(1) + " more"), (6, text(21) + " more"), (200, text(40))]
    df = corpus(rows).repartition(3)
    kept = sorted(r["text"].removesuffix(" more") for r in one_of_each(df, 4, 85).collect())
    assert kept == sorted(text(k) for k in range(60))
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(df, 4, 85).collect()), key=str)
    want = [(None, None)] * 20 + [(None, 7), (7, 7)] + [(4, 4)] * 21 + [(6, 4)] + [(i, i) for i in ids[40:]] + [(200, 100)]
    assert got == sorted(want, key=str)


def test_long_words_that_collide_modulo_a_power_of_two(spark, corpus):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever its base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word + "a"), (4, f"x {word} y"), (5, f"x {other} y"), (6, "a" * 24), (7, "a" * 25), (8, "a" * 23 + "\0")]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(corpus(rows)).collect())
    assert got == [(k, k) for k in range(1, 9)]


def test_template_of_many_documents(spark, corpus):
    """Documents that share most of a template are one looser group of several blocks, and link with few."""
    random.seed(4)
    template = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(template + [f"own{k}x{j}" for j in range(25)])) for k in range(700)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 700, 70)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(corpus(rows), 1, 85).collect())
    assert got == sorted([(k, 85, k) for k in range(700)] + [(1000 + k, 86, k) for k in range(0, 700, 70)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\nc", max_size=20), max_size=6), st.integers(1, 5))
def test_set_sizes(texts, n):
    data, ends = join([t.encode() for t in texts]) if texts else join([b""])
    found = shingles(data, ends, n)[1]
    sizes = [int(b - a) for a, b in zip([0, *found[:-1]], found)]
    assert sizes == [len(own_set(t, n)) for t in texts or [""]]


@given(st.integers(1, 300), st.integers(1, 300), st.integers(0, 300), st.integers(1, 100))
def test_no_link_below_the_need(a, b, both, percent):
    both = min(a, b, both)
    if linked(both, a, b, percent):
        assert both >= _need(a, percent) and both >= _need(b, percent)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
