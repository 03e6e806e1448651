from __future__ import annotations

from tidemark.plans import crawl
from tidemark.sources import html, seeds


def test_document_fields():
    page = """<html lang=" EN "><head><title> A  page </title><meta property="og:title" content="Better">
<meta name="description" content="About it"><link rel="icon" href="/i.png"></head><body><nav>Menu</nav>
<div><h2>Head</h2><p>One<p>Two <b>bold</b></div><script>x()</script>
<a href="/a/">A</a><a href="#top">T</a><a href="mailto:x@y">M</a><a href="/a#f">again</a></body></html>"""
    found = html.document("https://site.example/x", "site.example", page, {"Content-Type": "text/html"}, 7)
    fields = dict(zip([c.split()[0] for c in html.DOCUMENT.split(", ")], found))
    assert fields["title"] == "Better" and fields["meta_description"] == "About it" and fields["lang"] == "en"
    assert fields["headings"] == ["Head"] and fields["links"] == ["https://site.example/a"]
    assert fields["favicon_url"] == "https://site.example/i.png" and fields["body"] == "About it"
    assert html.document("https://s.example/", "s", " ", None, 1) is None
    assert html.document("https://s.example/", "s", "<p>x", {"content-type": "image/png"}, 1) is None


def test_blocks_are_paragraphs():
    long = "word " * 20
    root = html.parse(f"<body><p>{long}one<p>{long}two<div>{long}<span>in</span>line</div></body>")
    assert len(html.body_text(root).split("\n\n")) == 3


def test_homepage_gets_its_name():
    found = html.homepage_body("https://www.site.example/", "Name", "About", ["H"], "short")
    assert found == "site - site.example\n\nName\n\nAbout\n\nH. \n\nshort"
    assert html.homepage_body("https://site.example/a", "Name", None, [], "short") == "short"


def test_extract_skips_nulls(spark):
    rows = spark.createDataFrame([("https://a.example/", "a.example", None, None, None), (None, None, "<p>x</p>", None, 1), ("https://b.example/", None, "<p>text</p>", None, 2)],
                                 "url string, domain string, html string, headers map<string,string>, crawled_at long")
    assert [r["url"] for r in html.extract(rows).collect()] == ["https://b.example/"]
    assert html.extract(rows.limit(0)).count() == 0


def test_seeds(spark):
    raw = spark.createDataFrame([('"https://a.example"',), ('{"url": "https://b.example", "depth": 1, "priority": "high", "sitemap": true}',), ("nonsense",)], "raw string")
    found = {r["url"]: r for r in seeds.seeds(raw).collect()}
    assert set(found) == {"https://a.example", "https://b.example"}
    assert found["https://a.example"]["depth"] == 3 and found["https://b.example"]["priority"] == "high" and found["https://b.example"]["sitemap"]
    ranked = seeds.by_priority(seeds.seeds(raw), "url").collect()
    assert ranked[0]["url"] == "https://b.example"


def test_sitemap_and_domains(spark):
    maps = spark.createDataFrame([("h", "<urlset><url><loc> https://h/a </loc></url><url><loc>ftp://no</loc></url></urlset>"), ("i", "<sitemapindex><loc>https://i/s.xml</loc></sitemapindex>")], "host string, xml string")
    found = {(r["host"], r["is_index"], r["loc"]) for r in seeds.sitemap_locations(maps).collect()}
    assert found == {("h", False, "https://h/a"), ("i", True, "https://i/s.xml")}
    lines = spark.createDataFrame([("1,blog.example.org",), ("x,bad.com",), ("2,cdn1.com",), ("3,www.known.com",), ("40,science.edu",)], "value string")
    known = spark.createDataFrame([("known.com",)], "domain string")
    found = [(r["domain"], r["priority"], r["depth"]) for r in seeds.ranked_domains(lines, known, 10).collect()]
    assert found == [("science.edu", "high", 3), ("blog.example.org", "high", 3)]
    entries = spark.createDataFrame([("*.alpha.dev\nbeta.dev", "alpha.dev"), (None, "alpha.dev")], "name_value string, common_name string")
    found = [(r["domain"], r["n"]) for r in seeds.certificate_domains(entries, known, 10).collect()]
    assert found[0] == ("alpha.dev", 3)
    stories = spark.createDataFrame([(1, "https://www.xylo.io/1"), (2, "https://xylo.io/2"), (3, "https://known.com/")], "pos int, url string")
    assert [(r["domain"], r["n"], r["url"]) for r in seeds.story_domains(stories, known, 5).collect()] == [("xylo.io", 2, "https://www.xylo.io/1")]


def test_robots(spark):
    lines = ["User-agent: other", "Disallow: /", "User-agent: *", "Disallow: /a", "Allow: /a/b", "Disallow: /a/b # tie", "Crawl-delay: 4", "Disallow:"]
    rules = crawl.robots_rules(spark.createDataFrame([("h.example", k, x) for k, x in enumerate(lines)], "domain string, line_no int, line string"))
    links = spark.createDataFrame([("https://h.example/",), ("https://h.example/a/x",), ("https://h.example/a/b/c?q",), ("https://free.example/a",)], "url string")
    found = {r["url"]: r["allowed"] for r in crawl.robots_allowed(links, rules).collect()}
    assert found == {"https://h.example/": True, "https://h.example/a/x": False, "https://h.example/a/b/c?q": False, "https://free.example/a": True}
    assert rules.select("crawl_delay").distinct().collect()[0][0] == 4


def test_frontier(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "k"), ("d", "a"), ("b", "f.pdf")]
    graph = spark.createDataFrame([(f"https://s.example/{x}", f"https://s.example/{y}") for x, y in edges] + [("https://s.example/a", "https://t.example/z")], "src string, dst string")
    start = spark.createDataFrame([("https://s.example/a", 2, "same_domain")], "url string, depth_limit int, scope string")
    known = spark.createDataFrame([("https://s.example/k",)], "url string")
    found = {(r["url"][-1], r["depth"]) for r in crawl.frontier(start, graph, known).collect()}
    assert found == {("a", 0), ("b", 1), ("c", 2)}


def test_seed_tables(spark):
    ids = spark.createDataFrame([("[5, 3, 9]",), ("[3, 1]",), ("bad",), (None,)], "json string")
    assert [r[0] for r in seeds.story_ids(ids, 3).collect()] == [1, 3, 5]
    table = spark.createDataFrame([("a",), ("b",)], "url string")
    more = seeds.append_seed(table, spark.createDataFrame([("b",), ("c",)], "url string"))
    assert sorted(r[0] for r in more.collect()) == ["a", "b", "c"]
    assert [r[0] for r in seeds.remove_seed(table, "a").collect()] == ["b"]
    assert html.canonical(html.parse("<head><link rel=canonical href='/x'></head>"), "https://a.example/b") == "https://a.example/x"
