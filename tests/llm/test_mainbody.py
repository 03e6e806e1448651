from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.mainbody import MainBody, Page, blocks, main_lines

PAGE = """<html><head><title>T</title><style>.main { x }</style></head>
<body>
<div class="content"><p>We use cookies to remember your settings. They help us to serve this site to you.</p>
<button>OK</button></div>
<NAV><ul>
<li><a href="/a">Home</a></li>
</ul></NAV>
<p>Last updated 3 days ago</p>
<div class="xyz">
<h1>The headline</h1>
<p>This is the first paragraph of the text, <a href="/r">and a long link goes on and on in it.</a>
<p>The second one is unclosed too. It has
a line of its own.</p>
<div class="promo"><a href="/9">Another page entirely</a></div>
<ul><li>A list item that ends like a sentence does.</li></ul>
</div>
<script>if (a < b) { write('<p>no</p>') }</script>
<section class="article">
<p><b>A reader</b>: I have a lot to say about this text, and I do say it here.</p>
<p><b>Another</b>: I have even more to say about this text than the first one had to say.</p>
</section>
<footer><p>All rights reserved by the publisher; copying needs written consent.</p></footer>
</body></html>"""


def texts(source):
    page = Page(source)
    return [page.lines[k].text for k in main_lines(source, page)]


def test_main_body_only():
    found = texts(PAGE)
    assert found[0] == "The headline" and found[1].startswith("This is the first") and found[-1].startswith("A list item")
    assert len(found) == 5 and not any("cookies" in x or "reader" in x or "rights" in x or "Another page" in x for x in found)


def test_no_paragraph_no_body():
    assert main_lines("<body><div>404 - Not Found</div>\n<div>The page you asked for could not be found. It may have been moved.</div></body>") == []
    assert main_lines(None) == [] and main_lines("") == [] and main_lines("\n\n") == []


P = [f"<p>Paragraph {k} of this article says what the harbour office keeps in its archive.</p>" for k in range(6)]


def test_nothing_whole_is_discarded():
    """Pages without elements, wrapped, split, with a share button, with a row of links; and lines beyond a dive."""
    said = lambda source: [x for x in texts(source) if x.startswith("Paragraph")]
    assert len(said("<body>\n<h1>Head</h1>\n" + "\n".join(P) + "\n</body>")) == 6
    assert len(said("<body><div>\n<h1>Head</h1>\n" + "\n".join(P[:3]) + "\n<button>Share</button>\n" + "\n".join(P[3:]) + "\n</div></body>")) == 6
    row = '<p><a href="/1">Home</a> <a href="/2">News</a> <a href="/3">About us</a></p>'
    assert len(said("<body><div>\n<h1>Head</h1>\n" + row + "\n" + "\n".join(P) + "\n</div></body>")) == 6
    assert len(said("<body>\n<div>\n<h1>Head</h1>\n" + "\n".join(P[:3]) + "\n</div>\n<div>\n" + "\n".join(P[3:]) + "\n</div>\n</body>")) == 6
    wrapped = "<body><div>\n<nav>\n" + row + "\n</nav>\n<div>\n<h1>Head</h1>\n" + "\n".join(P) + "\n</div>\n<footer>\n<p>All rights are reserved by the publisher of this site.</p>\n</footer>\n</div></body>"
    assert len(said(wrapped)) == 6 and len(texts(wrapped)) == 7
    assert "Filed" not in texts("<body><div>\n<h1>Head</h1>\n" + "\n".join(P) + "\n\n\n\n<p>Filed</p>\n\n\n\n</div></body>")


def test_blocks():
    assert blocks([0, 0, 30, 40, 0, 5, 0, 0, 0, 60]) == [(2, 5), (9, 9)]
    assert blocks([]) == [] and blocks([3, 2, 1]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</P>", "<a href='x'>", "</a>", "text.", "\n", "<!-- c", "-->", "<", "&amp;", "<script>", "</script>", "<b>", "</table>", "<td>"]), max_size=40))
def test_any_markup(parts):
    source = "".join(parts)
    assert all(0 <= k <= source.count("\n") for k in main_lines(source))


def test_rows(spark):
    rows = [(1, PAGE, "clash"), (1, PAGE, "clash"), (2, None, None), (3, "", None), (None, PAGE, None), (4, PAGE.replace("The second", "word " * 40_000 + "."), None)]
    df = spark.createDataFrame(rows, "fetch_no long, html string, line_no string")
    found = MainBody().lines(df).collect()
    assert {r["fetch_no"] for r in found} == {1, 4} and len(found) == 10
    assert MainBody().lines(df.limit(0)).count() == 0
    bodies = {r["fetch_no"]: r["body"] for r in MainBody().bodies(df).collect()}
    assert bodies[1].startswith("The headline") and bodies[3] == "" and set(bodies) == {1, 3, 4}
