from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html as H, urls as U
from corpusmill.operators import pages as P

LONG = "This paragraph is long enough to count as a meaningful part of the page"
PAGE = f"""<!DOCTYPE html><html><head><!-- <title>no</title> --><title>Main &amp; title</title>
<meta name="description" content="A 'short' summary &eacute;"><meta name=keywords content="one, two,three">
<meta property="og:title" content="OG"><meta name="author" content="Zoe Ray"><meta name="dup" content="first">
<meta name="dup" content="second"><meta property="article:published_time" content="2024-02-03"><meta charset=utf-8>
<script>var p = "<p>{LONG} from a script</p>";</script></head><body><nav><a href="/nav">N</a></nav>
<article><h1>Head</h1><p>{LONG} one<p>short<p><b>{LONG}</b> &lt;two&gt;</p><div>outside</div>
<span class="post-author">Al Bee</span><img src="../i/a.png" alt="A" title=T><img alt="none"><img src='http://o.example/b.png'>
<a href="x?q=1#f">in <i>side</i></a><a href="https://other.example/">out</a><a href="">self</a></article>
<p>{LONG} after</p><footer>f</footer></body></html>"""
URL = "http://h.example/d/p.html?z=1"


@pytest.fixture(scope="module")
def record(spark):
    return P.page_records(spark.createDataFrame([(URL, PAGE)], "url string, html string"), abstract_chars=500).first()


def test_fields(record):
    assert record.domain == "h.example"
    assert record.title == "Main & title"
    assert record.content == f"{LONG} one {LONG} <two>"
    assert record.abstract == "A 'short' summary é"
    assert record.metadata["dup"] == "second" and record.metadata["og:title"] == "OG" and len(record.metadata) == 6
    assert record.authors == ["Al Bee", "Zoe Ray"]
    assert record.date == "2024-02-03"
    assert record.keywords == ["one", "two", "three"]


def test_images_and_links(record):
    assert [i.asDict() for i in record.images] == [
        {"url": "http://h.example/i/a.png", "alt": "A", "title": "T"},
        {"url": "http://o.example/b.png", "alt": "", "title": ""},
    ]
    assert [(x.url, x.text) for x in record.links] == [
        ("http://h.example/nav", "N"), ("http://h.example/d/x?q=1#f", "in side"), (URL, "self"),
    ]


def parse(spark, html):
    return P.page_records(spark.createDataFrame([(URL, html)], "url string, html string"), abstract_chars=500).first()


def test_fallbacks(spark):
    bare = parse(spark, f"<h1>Only <i>head</i></h1><p>{'x' * 600}</p><time datetime=2020>t</time>")
    assert bare.title == "Only head" and bare.abstract == "x" * 500 and bare.date == "2020" and bare.keywords == []
    assert parse(spark, "<p>x</p>").title == "No title"
    assert parse(spark, '<meta name="description" content=""><p>y</p>').abstract == ""
    assert parse(spark, '<meta property="og:title" content="OG &amp; co">').title == "OG & co"
    by_class = parse(spark, f"<p>{LONG} a</p><div id=x class='my-entry'><p>{LONG} b</p></div>")
    assert by_class.content == f"{LONG} b"
    empty_article = parse(spark, f"<article>none</article><main><p>{LONG} m</p></main>")
    assert empty_article.content == f"{LONG} m"
    assert parse(spark, None).content == ""


def test_limits(spark):
    many = "".join(f"<img src=/i{i}><a href=/l{i}>{i}</a>" for i in range(80))
    df = spark.createDataFrame([(URL, many)], "url string, html string")
    record = P.page_records(df, max_images=20, max_links=50).first()
    assert len(record.images) == 20 and len(record.links) == 50 and record.links[49].url == "http://h.example/l49"


def test_generic_parse(spark):
    rows = [
        ("a", "<title>T</title><header><h1>no</h1></header><article> one <b>two</b> <script>x</script> three</article>"),
        ("b", "<h1> A <i>b</i></h1><div class='x content y'>in <p>side</p></div>"),
        ("c", "<p> one </p><p></p><p>two</p>"),
        ("d", "<div class=contents>no</div><p>para</p>"),
    ]
    got = {r.url: r for r in P.generic_records(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["a"].title, got["a"].abstract, got["a"].source) == ("T", "one two three", "generic")
    assert (got["b"].title, got["b"].abstract) == ("Ab", "in side")
    assert got["c"].abstract == "one  two" and got["d"].abstract == "para"


def test_custom_parser_keeps_failures(spark):
    pages = spark.createDataFrame([("u1", "good"), ("u2", "bad"), ("u3", "skip")], "url string, html string")

    def parser(content, url):
        if content == "bad":
            raise ValueError("broken page")
        return None if content == "skip" else {"n": len(content)}

    got = {r.page_url: r for r in P.parse_pages(pages, parser, "n bigint").collect()}
    assert set(got) == {"u1", "u2"} and got["u1"].n == 4 and got["u2"].error == "ValueError: broken page"


BASES = ["http://a.example/b/c/d?q=1#f", "https://h.example", "https://h.example/", "http://x.example:80/p/"]
REFS = ["g", "./g", "g/", "/g", "//g.example/z", "?y", "g?y", "#s", "g#s", "", "..", "../", "../g", "../..", "../../../g",
        "/./g", "/../g", "g.", "./g/.", "g/../h", "http://o.example/x", "mailto:a@b", "/a//b", "x//y", "."]


def test_resolution_agrees_with_the_standard_library(spark):
    rows = [(b, r, urljoin(b, r)) for b in BASES for r in REFS]
    df = spark.createDataFrame(rows, "b string, r string, e string")
    assert df.where(U.resolve("b", "r") != F.col("e")).count() == 0


def test_authority(one):
    for url in BASES + ["https://u:p@h.example:8080/x y?z", "no-scheme/path", ""]:
        assert one(url, U.authority) == urlparse(url).netloc


def test_regions_end_with_their_element(spark):
    long = "A paragraph that is long enough to count as content of the page, surely."
    pages = [
        ("d", f"<div class='content'><div><p>{long} 1</p></div><DIV></DIV><p>{long} 2</p></div><div class='cookie'><p>{long} 3</p></div>", [1, 2]),
        ("n", f"<article><p>{long} 1</p><article><p>{long} 2</p></article><p>{long} 3</p></article><p>{long} 4</p>", [1, 2, 3]),
        ("u", f"<div id=\"post\"><p>{long} 1</p><div><p>{long} 2</p>", [1, 2]),
        ("o", f"<p>{long} 1</p><section class='content'><section><p>{long} 2</p></section></section><section><p>{long} 3</p></section>", [1, 2, 3]),
    ]
    df = spark.createDataFrame([(u, h) for u, h, _ in pages], "url string, html string")
    got = {r.url: r.content for r in P.page_records(df).collect()}
    for url, _, numbers in pages:
        assert got[url] == " ".join(f"{long} {n}" for n in numbers), url
    generic = {r.url: r.abstract for r in P.generic_records(df).collect()}
    assert generic["d"].endswith("2") and "3" not in generic["d"] and generic["o"] == f"{long} 2"


def test_no_limit_unless_asked(spark):
    html = "".join(f"<a href='/{i}'>{i}</a><img src='/{i}.png'>" for i in range(70))
    df = spark.createDataFrame([(URL, html)], "url string, html string")
    assert P.link_edges(df).count() == 70
    row, cut = P.page_records(df).first(), P.page_records(df, max_images=20, max_links=50).first()
    assert (len(row.links), len(row.images), len(cut.links), len(cut.images)) == (70, 70, 50, 20)
