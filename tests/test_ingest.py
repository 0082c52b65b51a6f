import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lumenary.operators import digest, extract, report
from lumenary.operators.index import StaleIndex
from lumenary.sources import articles, rest


class Site(http.server.BaseHTTPRequestHandler):
    posts: list[dict] = []
    broken: set[int] = set()

    def do_GET(self):
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        page, size = int(asked["page"]), int(asked["per_page"])
        held = [p for p in self.posts if p["date"] > asked.get("after", "") and p["date"] < asked.get("before", "9")]
        held.sort(key=lambda p: p["date"], reverse=True)
        found = held[(page - 1) * size : page * size]
        if page in self.broken or (page > 1 and not found):
            self.send_error(400)
            return
        body = json.dumps(found).encode()
        self.send_response(200)
        self.send_header("X-WP-Total", str(len(held)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def post(k: int, words: int = 30) -> dict:
    return {
        "title": {"rendered": f"Post {k}"}, "content": {"rendered": "<p>" + " ".join(f"w{k}x{j}" for j in range(words)) + "</p>"},
        "date": f"2024-01-{k + 1:02d}T10:00:00", "link": f"https://site.example/post-{k}", "categories": [1 + k % 2],
    }


@pytest.fixture
def site():
    Site.posts, Site.broken = [post(k) for k in range(25)], set()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/posts"
    server.shutdown()


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, "News"), (2, "Sport")], "id int, name string")


def test_pages_since_a_day_are_complete(spark, site, labels):
    known = spark.createDataFrame([("https://site.example/post-20/",)], "url string")
    got = rest.collect(spark, site, labels, known, after="2024-01-10", per_page=4)
    assert got.complete and (got.scanned, got.total) == (15, 15)
    assert {r["url"] for r in got.articles.collect()} == {f"https://site.example/post-{k}/" for k in range(10, 25) if k != 20}
    assert got.articles.filter("title = 'Post 11'").first()["category"] == "Sport"


def test_a_failed_or_missing_page_is_not_complete(spark, site, labels):
    Site.broken = {2}
    got = rest.collect(spark, site, labels, after="2024-01-10", per_page=4)
    assert not got.complete and got.failed == 1 and got.scanned == 11
    Site.broken = set()
    assert not rest.collect(spark, site, labels, after="2024-01-10", per_page=4, most_pages=2).complete


def test_update_modes(spark, site, labels):
    none = spark.createDataFrame([], articles.ARTICLES)
    held, complete = rest.update(spark, "initial", site, labels, none, per_page=5, pages={"initial": 2})
    assert complete and held.count() == 10
    older, reached = rest.update(spark, "target", site, labels, held, target=18, per_page=5)
    assert reached and older.count() >= 18
    everything, reached = rest.update(spark, "target", site, labels, held, target=99, per_page=5)
    assert not reached and everything.count() == 25
    assert rest.update(spark, "target", site, labels, held, target=18, private=["News"], per_page=5)[1] is False
    Site.posts.append(post(25) | {"date": "2024-01-25T09:00:00"})  # a late one, on the newest day
    newer, complete = rest.update(spark, "since", site, labels, held, per_page=5)
    assert complete and newer.count() == 11
    with pytest.raises(ValueError):
        rest.update(spark, "sometimes", site, labels, held)
    with pytest.raises(ValueError):
        rest.update(spark, "since", site, labels, none)


def test_posts_keep_paragraphs_only(spark, labels):
    body = "<script>var a=1;</script><p>One</p>tail text<p>Two &#8220;x&#8221;</p><style>p{}</style>"
    rows = [{"title": {"rendered": "T &eacute; <i>&#8220;x&#8221;</i>"}, "content": {"rendered": body}, "date": "2024-01-01", "link": "https://s.example/a#b", "categories": [2, 1, 9]},
            {"title": {"rendered": None}, "content": {"rendered": "no paragraph &amp; more<script>x</script>"}, "date": None, "link": "https://s.example/b/", "categories": None}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "post string")
    got = {r["url"]: r for r in articles.from_posts(df, labels).collect()}
    one, two = got["https://s.example/a/"], got["https://s.example/b/"]
    assert (one["title"], one["content"], one["category"]) == ("T é “x”", "One\nTwo “x”", "Sport, News")
    assert (two["title"], two["content"], two["category"]) == ("", "no paragraph & more", "Uncategorized")


def test_subtrees_of_any_depth(spark):
    rows = [(1, 0, i, max(i - 1, 0), "x", "NOUN", "a", f"t{i}") for i in range(40)]
    reached = extract.subtrees(spark.createDataFrame(rows, extract.TOKENS))
    assert reached.filter("root = 0").count() == 40 and reached.count() == reached.distinct().count() == 40 * 41 // 2
    circle = [(1, 0, i, (i + 1) % 3, "x", "NOUN", "a", "t") for i in range(3)]
    with pytest.raises(ValueError):
        extract.subtrees(spark.createDataFrame(circle, extract.TOKENS))


def test_a_parser_from_outside(spark):
    def make_parser():
        """Three words: subject, verb, object; capital letters are entities."""

        def parse(texts):
            out = []
            for text in texts:
                tokens, entities = [], []
                for k, word in enumerate(text.split()):
                    dep, pos, head = (("nsubj", "NOUN", k + 1), ("ROOT", "VERB", k), ("obj", "NOUN", k - 1))[k % 3]
                    tokens.append((k // 3, k, head, dep, pos, word.lower(), word))
                    if word[0].isupper():
                        entities.append((k, k + 1, "PER", word))
                out.append((tokens, entities))
            return out

        return parse

    docs = spark.createDataFrame([(1, "Ana sees birds birds see Bo"), (2, None), (3, "")], "doc_id long, text string")
    found, triples = extract.extracted(docs, make_parser, batch=1)
    assert sorted((r["sent"], r["entity"]) for r in found.collect()) == [(0, "Ana"), (1, "Bo")]
    assert sorted((r["subject"], r["relation"], r["object"], r["object_label"]) for r in triples.collect()) == [("Ana", "sees", "birds", ""), ("birds", "see", "Bo", "PER")]
    tokens, _ = extract.parsed(docs, make_parser)
    assert {r["sentence"] for r in extract.sentences(tokens).collect()} == {"Ana sees birds", "birds see Bo"}


def test_reports_and_checked_exports(spark, tmp_path):
    path = str(tmp_path / "summary.json")
    report.merge_section(path, "a", {"n": 1})
    assert report.merge_section(path, "b", {"n": 2}) == {"a": {"n": 1}, "b": {"n": 2}}
    held = spark.createDataFrame([(1, "t1", "u1", "h1"), (2, "t2", "u2", "h2")], "doc_id long, title string, url string, content_hash string")
    points = spark.createDataFrame([(1, 0, 0.123456789, 1.0, 2.0), (2, 1, 0.0, 1.0, 2.0)], "doc_id long, cluster int, x double, y double, z double")
    measures = spark.createDataFrame([(0.5, 2)], "silhouette double, k int")
    folder = str(tmp_path / "out")
    assert report.export_results(spark, held, held, points, measures, folder)["clusters"] == 2
    assert spark.read.parquet(f"{folder}/points").filter("doc_id = 1").first()["x"] == 0.12346
    assert spark.read.csv(f"{folder}/measures", header=True).first()["k"] == "2"
    with pytest.raises(StaleIndex):
        report.export_results(spark, held, held.withColumn("url", F.lit("z")), points, measures, folder)
    with pytest.raises(StaleIndex):
        report.export_results(spark, held, held.filter("doc_id = 1"), points, measures, folder)


def test_delivery_state_and_forms(spark):
    state = spark.createDataFrame([("a", ["u1", "u2"]), ("b", ["u9"])], "user string, seen array<string>")
    new = spark.createDataFrame([("a", "u3", 2), ("a", "u2", 1), ("c", "u5", 1)], "user string, url string, position int")
    assert {r["user"]: r["seen"] for r in digest.delivered(state, new, 2).collect()} == {"a": ["u2", "u3"], "b": ["u9"], "c": ["u5"]}
    rows = spark.createDataFrame([("u1",), ("u7",)], "url string")
    assert [r["url"] for r in digest.unseen(rows, state, "a").collect()] == ["u7"]
    form = {"area": "x", "frequency": "daily", "hour": "07:30", "email": " a@b.org "}
    assert digest.check_form(form, ["x"])["email"] == "a@b.org"
    for change in ({"area": "y"}, {"frequency": "hourly"}, {"hour": "25:00"}, {"email": "a@b"}, {"weekday": 7}):
        with pytest.raises(ValueError):
            digest.check_form(form | change, ["x"])


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lumenary import __main__, session

    monkeypatch.setattr(__main__, "build_session", lambda: spark)
    rows = [(k, " ".join(["good", "rain", f"word{k % 3}"] * 10), "src1", "en", 100) for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "lexicon.json").write_text(json.dumps({"words": {"good": 1.0}}))
    data = ["--data", str(tmp_path)]
    __main__.main([*data, "profile"])
    __main__.main([*data, "compare", "good rain"])
    __main__.main([*data, "evaluate", "good", "word1"])
    __main__.main([*data, "sentiment", "--lexicon", str(tmp_path / "lexicon.json")])
    said = capsys.readouterr().out
    assert "duplicate_hashes" in said and "manhattan" in said and "src1: 5" in said and "positive" in said
    assert session.TABLES


def test_update_command(spark, site, tmp_path, capsys, monkeypatch):
    from lumenary import __main__

    monkeypatch.setattr(__main__, "build_session", lambda: spark)
    folder = str(tmp_path / "articles")
    given = ["--data", str(tmp_path), "update", "since", "--since", "2024-01-20", "--endpoint", site, "--articles", folder]
    __main__.main(given)
    __main__.main(given)
    assert "complete" in capsys.readouterr().out and articles.read_articles(spark, folder).count() == 5
