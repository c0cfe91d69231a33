"""Hand-made corpora with expected values, an independent scorer, and persistence."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from findwell.config import Config
from findwell.functions.stemming import stem, with_stem
from findwell.functions.text import path_parts, prepare_query
from findwell.operators import indexing as ix
from findwell.operators import search as sr
from findwell.operators.index import build_index, load_index, merge_indexes, read_json_postings
from findwell.sources.pages import parsed_segments, read_corpus

D2 = "<html><body><p>blue fox and big red dog</p><script>red fox</script></body></html>"
PAGES = [
    ("d1", "http://a.example/x/y.html", '<html><head><title>Red Fox</title><meta name="keywords" content="fox den"></head><body><h1>Fox</h1><p>red <b>fox</b> tail lost<br>gone<!-- c -->out</p></body></html>'),
    ("d2", "http://a.example/x", D2),
    ("d3", "http://a.example/mirror/of/x", D2),
    ("d4", "http://a.example", "<html><body><h2>Dog caf&eacute; W&ouml;rld</h2></body></html>"),
    ("d5", "http://a.example/empty", ""),
]


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame(PAGES, "page_id string, url string, html string")
    tokens = ix.page_tokens(pages).cache()
    return tokens, ix.postings(ix.word_rows(ix.distinct_tokens(tokens))).cache()


def test_occurrences_of_pages(corpus):
    rows = {}
    for r in ix.occurrences(corpus[0]).orderBy("doc_id", "pos").collect():
        rows.setdefault(r["doc_id"], []).append((r["pos"], r["tag"], r["token"]))
    assert rows["d1"] == [(0, "meta", "fox"), (1, "meta", "den"), (2, "title", "red"), (3, "title", "fox"), (4, "h1", "fox"), (5, "p", "red"), (6, "b", "fox")]
    assert rows["d2"] == [(0, "p", "blue"), (1, "p", "fox"), (2, "p", "and"), (3, "p", "big"), (4, "p", "red"), (5, "p", "dog")]
    assert rows["d4"] == [(0, "h2", "dog"), (1, "h2", "caf"), (2, "h2", "w"), (3, "h2", "rld")]
    assert "d5" not in rows


def test_duplicates_and_frequencies(corpus):
    df = {r["token"]: r["df"] for r in ix.vocabulary(corpus[1]).collect()}
    assert (df["fox"], df["red"], df["dog"]) == (2, 2, 2)
    urls = {r["doc_id"]: r["url"] for r in corpus[1].select("doc_id", "url").distinct().collect()}
    assert urls["d2"] == "http://a.example/x" and "d3" not in urls


@pytest.mark.parametrize(
    "terms, tolerance, mode, expected",
    [
        (["fox"], 1, "and", {"d1": 95.036381, "d2": 15.816167}),
        (["red", "fox"], 1, "and", {"d1": 150.721238, "d2": 29.132333}),
        (["red", "fox"], 1, "or", {"d1": 152.387905, "d2": 31.632333}),
        (["fox", "dog"], 1, "and", {"d2": 29.132333}),
        (["red", "fox", "den"], 1, "and", {"d1": 197.380548}),
        (["fox", "zzz"], 1, "and", {"d1": 95.036381, "d2": 15.816167}),
        (["zzz"], 1, "and", {}),
        (["red", "dog"], 2, "and", {"d2": 39.132333}),
    ],
)
def test_scores(spark, corpus, terms, tolerance, mode, expected):
    found = sr.search(corpus[1], sr.query_table(spark, [(0, terms, tolerance)]), 5, mode)
    assert {r["doc_id"]: round(r["score"], 6) for r in found.collect()} == pytest.approx(expected, abs=1e-6)


def test_compat_labels_drop_the_boost(spark, corpus):
    found = sr.search(corpus[1], sr.query_table(spark, [(0, ["red", "fox", "den"], 1)]), 5, "and", Config(compat_labels=True))
    assert [round(r["score"], 6) for r in found.collect()] == [187.380548]


@pytest.mark.parametrize(
    "positions, tolerance, runs",
    [
        ([(1, 0), (2, 1)], 1, 1),
        ([(1, 0), (9, 1)], 1, 0),
        ([(0, 0), (9, 1)], 1, 1),
        ([(1, 0), (3, 1)], 2, 1),
        ([(1, 0), (2, 1), (5, 0), (6, 1)], 1, 2),
        ([(1, 0), (2, 0)], 1, 0),
        ([(3, 1), (4, 0)], 1, 1),
    ],
)
def test_phrase_runs(spark, positions, tolerance, runs):
    rows = spark.createDataFrame([(0, 1, p, k, tolerance) for p, k in positions], "qid int, doc_id int, pos int, k int, tolerance int")
    assert sr.phrase_runs(rows).where("n_terms >= 2").count() == runs


def test_url_parts(spark):
    urls = {"http://a.b.edu": 1, "http://a.b.edu/": 2, "http://a.b.edu/x/y?q=1#z": 3, "http://a.b.edu/x;p=1": 2, "http://a b/x": 2, "a.b.edu/x": 2, "http://a.b.edu/x|y": 2}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", path_parts(F.col("url")).alias("n"))
    assert {r["url"]: r["n"] for r in df.collect()} == urls


def test_prepared_queries():
    plain = {"Red fox": (["red", "fox"], 1), "the red fox": (["red", "fox"], 2), "to be": (["to", "be"], 1), "to be?": (["to", "be"], 1), "fox fox": (["fox"], 1), "wörld": (["w", "rld"], 1), "": ([], 1)}
    for text, expected in plain.items():
        assert prepare_query(text) == expected


def test_stems_of_the_paper(spark):
    pairs = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam predication predic operator oper hopefulness hope formaliti formal triplicate triplic formative form goodness good revival reviv airliner airlin gyroscopic gyroscop adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll dying die his hi enjoy enjoy".split()
    expected = dict(zip(pairs[::2], pairs[1::2]))
    assert {w: stem(w) for w in expected} == expected
    rows = with_stem(spark.createDataFrame([(w,) for w in expected], "word string"))
    assert {r["word"]: r["stem"] for r in rows.collect()} == expected


def test_full_parser_agrees_on_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    from findwell.functions.text import words

    parsed = parsed_segments(pages).select("page_id", F.flatten(F.transform("segments", lambda s: words(s["txt"]))).alias("w"))
    native = ix.page_tokens(pages).select(F.col("doc_id").alias("page_id"), F.col("tokens.token").alias("w"))
    assert sorted(map(tuple, parsed.collect())) == sorted(map(tuple, native.collect()))


def test_independent_scorer(spark, small):
    """A plain Python scorer over documents, for two terms and AND."""
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    import re

    words = {d: [w.lower() for w in re.split("[^a-zA-Z0-9]+", t or "") if w] for d, _, t in docs}
    terms, tolerance = ["the", "and"], 2
    df = {t: sum(t in w for w in words.values()) for t in terms}
    expected = []
    for d, source, _ in docs:
        w = words[d]
        if not all(t in w for t in terms):
            continue
        score = sum(50 * w.count(t) / len(w) * math.log10(len(docs) / df[t]) + 10 for t in terms) + 5 / 2
        runs, current, before = [], set(), None
        for p, x in [(p, x) for p, x in enumerate(w) if x in terms]:
            if before and p - before > tolerance:
                runs.append(current)
                current = set()
            current.add(x)
            before = p
        runs.append(current)
        expected.append((d, round(score + 10 * sum(len(r) == 2 for r in runs), 6)))
    expected = sorted(expected, key=lambda x: (-x[1], x[0]))[:250]
    from findwell.plans.queries import _one

    got = [(r["doc_id"], r["score"]) for r in _one("and2", "and")(spark, small).orderBy("rank").collect()]
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_index_on_disk(spark, tmp_path):
    folder = tmp_path / "corpus" / "part"
    os.makedirs(folder)
    for name, url, html in PAGES:
        (folder / name).write_text(json.dumps({"url": url, "encoding": "utf-8", "content": html}))
    pages = read_corpus(spark, str(tmp_path / "corpus"))
    index = build_index(spark, ix.page_tokens(pages, doc_id="url", html="content"), str(tmp_path / "index"))
    assert index.size == 5
    found = load_index(spark, str(tmp_path / "index")).search("red foxes").collect()
    assert [(r["rank"], r["url"]) for r in found] == [(1, "http://a.example/x/y.html"), (2, "http://a.example/x")]
    assert index.search("", page=None).count() == 0
    assert {r["doc_id"] for r in index.postings("dog").collect()} == {"http://a.example/mirror/of/x", "http://a.example"}
    plan = index.posts.where(F.col("token").isin("fox"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(token" in plan or "EqualTo(token" in plan
    other = spark.createDataFrame([("e1", "http://b.example/q", "<p>red fox again</p>")], "page_id string, url string, html string")
    second = build_index(spark, ix.page_tokens(other, doc_id="url"), str(tmp_path / "second"))
    merged = merge_indexes(spark, index, second, str(tmp_path / "merged"))
    assert merged.size == 6 and merged.search("fox", page=None).count() == 3
    assert {(r["qid"], r["rank"]) for r in merged.batch_search({7: "fox", 8: "dog"}).collect()} == {(7, 1), (7, 2), (7, 3), (8, 1), (8, 2)}


def test_merge_drops_duplicates_across_indexes(spark, tmp_path):
    schema = "page_id string, url string, html string"
    left = spark.createDataFrame([("a1", "http://a.example/long/path", "<p>red fox</p>"), ("a2", "http://a.example/2", "<p>blue dog</p>")], schema)
    right = spark.createDataFrame([("b1", "http://b.example/s", "<p>red fox</p>"), ("b2", "http://b.example/2", "<p>red dog</p>")], schema)
    parts = [build_index(spark, ix.page_tokens(d), str(tmp_path / n)) for d, n in ((left, "left"), (right, "right"))]
    merged = merge_indexes(spark, *parts, str(tmp_path / "merged"))
    assert merged.size == 4
    assert {r["token"]: r["df"] for r in merged.vocab.collect()} == {"red": 2, "fox": 1, "blue": 1, "dog": 2}
    assert [(r["doc_id"], r["url"]) for r in merged.postings("fox").collect()] == [("a1", "http://b.example/s")]
    words = build_index(spark, ix.page_tokens(left), str(tmp_path / "words"), stemmed=False)
    with pytest.raises(ValueError):
        merge_indexes(spark, parts[0], words, str(tmp_path / "bad"))


def test_many_terms_are_joined(spark, tmp_path):
    pages = spark.createDataFrame([("a", "http://a.example/1", "<p>red fox</p>"), ("b", "http://a.example/2", "<p>blue dog</p>")], "page_id string, url string, html string")
    few = build_index(spark, ix.page_tokens(pages), str(tmp_path / "index"))
    many = load_index(spark, str(tmp_path / "index"), Config(literal_terms=1, broadcast_terms=0))
    queries = {1: "red fox", 2: "dog", 3: "zebra"}
    assert sorted(few.batch_search(queries).collect()) == sorted(many.batch_search(queries).collect()) != []


def test_command_line(spark, tmp_path, capsys):
    from findwell import cli

    folder = tmp_path / "pages" / "part"
    os.makedirs(folder)
    for name, url, html in PAGES:
        (folder / name).write_text(json.dumps({"url": url, "encoding": "utf-8", "content": html}))
    index = str(tmp_path / "index")
    cli.main(["build", str(tmp_path / "pages"), index], spark)
    cli.main(["search", index, "red foxes"], spark)
    cli.main(["view", index, "--word", "dog"], spark)
    cli.main(["export", index, str(tmp_path / "json")], spark)
    said = capsys.readouterr().out
    assert "pages" in said and "1. http://a.example/x/y.html" in said and "1 to 2 results displayed.\n" in said
    stored = load_index(spark, index).posts
    back = read_json_postings(spark, str(tmp_path / "json"), "string")
    assert sorted(map(repr, back.select(stored.columns).collect())) == sorted(map(repr, stored.collect()))


def test_page_labels(spark):
    from findwell.operators.search import page_label

    def label(n, page):
        return tuple(page_label(spark.range(n), page).first())

    assert label(0, 1) == ("0 to 0", False, False)
    assert label(15, 1) == ("1 to 15", False, False)
    assert label(40, 2) == ("16 to 30", True, True)
    assert label(40, 3) == ("31 to 40", True, False)


def test_broken_json_postings(spark):
    rows = spark.createDataFrame([("fox", '{"doc_id":1,"url":"u","frequency":0.5,"tags":["p"],"position_v":[0]}'), ("dog", "{"), (None, None)], "token string, json string")
    got = {r["token"]: r["doc_id"] for r in ix.postings_from_json(rows).collect()}
    assert got == {"fox": 1, "dog": None, None: None}


def test_streaming_ingest(spark, tmp_path):
    from findwell.streaming.ingest import append_occurrences, read_page_stream

    folder = tmp_path / "in" / "part"
    os.makedirs(folder)
    for name, url, html in PAGES:
        (folder / f"{name}.json").write_text(json.dumps({"url": url, "encoding": "", "content": html}))
    append_occurrences(read_page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7 + 6 + 6 + 4
