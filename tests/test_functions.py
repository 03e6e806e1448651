from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import present, text, urls
from tidemark.functions.stem import stem
from tidemark.operators import search as se


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,out", [("running", "runn"), ("ring", "ring"), ("boxed", "box"), ("bed", "bed"), ("gas", "ga"), ("class", "class")])
def test_legacy_stem(spark, word, out):
    assert one(spark, text.legacy_stem(F.col("w")), w=word) == out


@pytest.mark.parametrize("word,out", [
    ("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("agreed", "agre"), ("owned", "own"), ("humbled", "humbl"), ("sized", "size"),
    ("meeting", "meet"), ("stating", "state"), ("siezing", "siez"), ("itemization", "item"), ("sensational", "sensat"), ("traditional", "tradit"),
    ("reference", "refer"), ("colonizer", "colon"), ("plotted", "plot"), ("generously", "generous"), ("consigned", "consign"), ("knightly", "knight"),
    ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("news", "news"), ("happy", "happi"), ("by", "by"), ("national", "nation"),
])
def test_stem(word, out):
    assert stem(word) == out


def test_bm25_goldens(spark):
    lit = lambda x: F.lit(float(x))
    assert one(spark, se.idf(lit(10), lit(2))) == pytest.approx(1.4816045, abs=1e-6)
    assert one(spark, se.idf(lit(1000), lit(1))) == pytest.approx(6.5032897, abs=1e-6)
    assert one(spark, se.term_score(lit(3), lit(2), lit(7), lit(10), lit(7))) == pytest.approx(2.3282357, abs=1e-6)


@pytest.mark.parametrize("title,query,base,out", [
    ("Rust async book", "rust", 2.0, 1.4), ("The Rust book", "rust", 2.0, 1.0), ("async in Rust", "rust async", 2.0, 1.7),
    ("async only", "rust async", 2.0, 0.7), ("Rust", "rust", 0.05, 0.07),
])
def test_title_bonus(spark, title, query, base, out):
    found = one(spark, text.title_bonus(F.col("t"), se.query_tokens(query), query, F.col("b")), t=title, b=base)
    assert found == pytest.approx(out, abs=1e-9)


@pytest.mark.parametrize("host,out", [("www.bbc.co.uk", "bbc.co.uk"), ("a.b.example.com", "example.com"), ("news.x.gov.uk", "gov.uk"), ("www.com.au", "com.au")])
def test_root_domain(spark, host, out):
    assert one(spark, urls.root_domain(F.col("h")), h=host) == out


@pytest.mark.parametrize("host,out", [("news.x.gov.uk", "x.gov.uk"), ("foo.net.nz", "foo.net.nz"), ("www.com.au", "www.com.au"), ("localhost", "localhost")])
def test_scope_domain(spark, host, out):
    assert one(spark, urls.scope_domain(F.col("h")), h=host) == out


@pytest.mark.parametrize("url,out", [("https://www.A.com/X/?q=1#f", "a.com/x"), ("http://a.com:8080/x#y?z", "a.com:8080/x"), ("HTTPS://a.com/", "https://a.com")])
def test_url_key(spark, url, out):
    assert one(spark, urls.url_key(F.col("u")), u=url) == out


@pytest.mark.parametrize("query,url,title,out", [
    ("github", "https://github.com/", "GitHub", 0.76), ("example", "https://www.example.org/a/b/c/d/e", "Example guide", 0.284),
    ("exam", "https://example.org/a", "Guide", 0.0268571), ("rust book", "https://rust-lang.org/learn", "The Rust book list", 0.026),
])
def test_url_boost(spark, query, url, title, out):
    assert one(spark, se.url_boost(F.col("u"), F.col("t"), query), u=url, t=title) == pytest.approx(out, abs=1e-6)


def test_quality_golden(spark):
    body = ("the quick brown fox jumps over the lazy dog near a river bank. it runs away quickly. "
            "then the dog sleeps all day long under trees.")
    assert one(spark, text.quality(F.col("b")), b=body) == pytest.approx(0.7038, abs=1e-4)


def test_human_bytes_and_kinds(spark):
    sizes = [one(spark, present.human_bytes(F.lit(n))) for n in (5, 1664, 5 * 1024**2, 3 * 1024**3)]
    assert sizes == ["5 B", "1.62 KB", "5.00 MB", "3.00 GB"]
    assert one(spark, present.content_type(F.lit("89504E470D0A"))) == "image/png"
    assert one(spark, present.content_type(F.lit("00000100"))) == "image/x-icon"


def test_snippet_and_highlight(spark):
    body = "filler words " * 40 + "the harbour map and the harbour wall " + "more words " * 40
    found = one(spark, text.snippet(F.col("b"), ["harbour", "map"]), b=body)
    assert "harbour" in found and found.startswith("…") and found.endswith("…")
    assert found.strip("…") in body
    assert one(spark, text.highlight(F.col("b"), "map"), b="A Map of maps") == "A <mark>Map</mark> of <mark>map</mark>s"


def greedy_cap(rows, query):
    """The cap as a walk over the ranking."""
    counts, out = {}, []
    for key, root, name in rows:
        limit = 10 if name == query or (len(query) >= 4 and name.startswith(query)) else 3
        if counts.get(root, 0) < limit:
            counts[root] = counts.get(root, 0) + 1
            out.append(key)
    return out


def test_domain_cap_equals_greedy(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows, data = [], []
        for key in range(120):
            root = rng.choice(["kettlefen.com", "other.org"])
            name = rng.choice(["kettle1", "shop"])
            url = f"https://{name}.{root}/p{key}"
            data.append((key, url, 1000.0 - key))
            rows.append((key, root, name))
        df = spark.createDataFrame(data, "doc_id long, url string, score double")
        found = [r[0] for r in se.cap_domains(df, "kettle").orderBy("doc_id").collect()]
        assert found == greedy_cap(rows, "kettle")
    alternating = [(k, f"https://{'kettle' if k % 2 else 'shop'}.kettlefen.com/{k}", 100.0 - k) for k in range(40)]
    df = spark.createDataFrame(alternating, "doc_id long, url string, score double")
    assert se.cap_domains(df, "kettle").count() == 10


def test_rrf_goldens(spark):
    lists = spark.createDataFrame([(0, 1, 5, "u", "t"), (1, 2, 5, "v", "w"), (0, 2, 6, "x", "y")], "list_no int, place int, doc_id long, url string, title string")
    found = {r["doc_id"]: r for r in se.rrf(lists, ["doc_id"], 0.01).collect()}
    assert found[5]["score"] == pytest.approx(0.0425225, abs=1e-6) and found[5]["url"] == "u"
    assert found[6]["score"] == pytest.approx(0.0161290, abs=1e-6)


def test_nulls(spark):
    rows = spark.createDataFrame([(None, None)], "title string, body string")
    found = rows.select(text.admitted(F.col("title"), F.col("body")).alias("a"), F.size(text.tokens(F.col("body"))).alias("n"),
                        urls.is_junk(F.col("title"), F.col("body")).alias("j"), urls.is_homepage(F.col("title")).alias("h")).first()
    assert (found["a"], found["n"], found["j"], found["h"]) == (False, 0, False, False)


@pytest.mark.parametrize("body,tokens,out", [
    ("the Harbour map", ["harbour", "map"], "the <mark>Harbour</mark> <mark>map</mark>"), ("mapmap", ["map"], "<mark>mapmap</mark>"), ("abcd", ["abc", "cd"], "<mark>abcd</mark>"),
    ("xmap", ["map"], "x<mark>map</mark>"), ("map", ["map"], "<mark>map</mark>"), ("", ["a"], ""), ("none here", ["zzz"], "none here"), ("ma map", ["map"], "ma <mark>map</mark>"),
])
def test_highlight_all(spark, body, tokens, out):
    assert one(spark, text.highlight_all(F.col("b"), tokens), b=body) == out


def test_stop_word_language(spark):
    found = [one(spark, text.stop_word_language(F.lit(t))) for t in ("the cat and the dog", "der Hund und die Katze", "xyz", " ")]
    assert found == ["en", "de", "und", None]


def test_hash_embedding(spark):
    a, b, c = (one(spark, se.hash_embedding(F.lit(t), 32)) for t in ("x", "x", "y"))
    assert a == b != c and abs(sum(x * x for x in a) - 1) < 1e-9 and len(a) == 32


def test_lsh_recall(spark):
    from pyspark.sql import Row

    rng = random.Random(2)
    rows = []
    for k in range(400):
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        rows.append(Row(vec_id=k, embedding=[x / n for x in v]))
    df = spark.createDataFrame(rows)
    hits = 0
    for q in range(0, 400, 50):
        true = {r["vec_id"] for r in se.nearest(df, rows[q].embedding, 5).collect()}
        hits += len(true & {r["vec_id"] for r in se.nearest_lsh(df, rows[q].embedding, 5).collect()})
    assert hits / 40 >= 0.9


def test_config(tmp_path):
    from tidemark import config

    path = tmp_path / "c.json"
    path.write_text('{"dimensions": 64, "crawler": {"max_depth": 1, "other": 2}, "unknown": 1}')
    found = config.load(str(path))
    assert found.dimensions == 64 and found.crawler.max_depth == 1 and found.storage.max_gb == 35.0
    path.write_text("{")
    with pytest.warns(UserWarning):
        assert config.load(str(path)) == config.Config()
    assert config.load(str(tmp_path / "none")) == config.Config()
    assert [config.storage_state(int(gb * 1024**3), found.storage) for gb in (1, 31, 40)] == ["ok", "warn", "stop"]


def test_query_terms_are_stem_and_legacy_stem():
    assert se.query_terms("harbours archived", "none") == ["harbours", "archived"]
    assert se.query_terms("harbours archived", "snowball") == ["harbour", "archiv"]
    assert se.query_terms("boxes", "snowball") == ["box", "boxe"]


def test_snippets_of_any_script():
    from tidemark.functions.text import best_window, mark

    body = "ä" * 10 + " " + "Füllwort und mehr " * 40 + "der alte Hafen liegt still " + "noch mehr Wörter hier " * 30
    found = best_window(body, ["hafen"], ["hafen"])
    assert "<mark>Hafen</mark>" in found and found.startswith("…") and found.endswith("…") and len(found.encode()) < 340
    assert best_window(None, ["x"]) == "" and best_window("", []) == "" and best_window("short", ["none"]) == "short"
    assert best_window("漢字" * 300, ["字"]).endswith("…")
    assert mark("Harbour Map", ["harbour", "our map"]) == "<mark>Harbour Map</mark>" and mark("İstanbul map", ["map"]) == "İstanbul <mark>map</mark>"
    assert mark(None, ["x"]) is None and mark("abab", ["ab"]) == "<mark>abab</mark>"
