"""References against the standard library's resolution."""

from urllib.parse import unquote, urljoin

from pyspark.sql import functions as F

from ragspark.operators import pages, urls

BASES = ["http://a/b/c/d;p?q", "https://h.example", "https://h.example/", "http://h/x/y/", "http://h/x/../y/./z?q=1#f", "HTTP://H/x", "http://h//x//y", "file:///etc/x", "http://h?q", "/only/path", ""]
REFERENCES = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
    "./../g", "./g/.", "g/./h", "g/../h", "http://other/x/../y", "https:g", "mailto:a@b.c", "javascript:void(0)", "HTTP://O/p", "a//b", "g?y/../x", "g#s/./x", "//o", "//o/../p", "é/ü?ö",
]


def test_resolution(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    # The library loses the root of a file address when a reference leads above it; RFC 3986 ends at the root.
    want = lambda b, r: "file:///g" if urljoin(b, r) == "file:g" else urljoin(b, r)
    wrong = [(x.b, x.r, x.u, want(x.b, x.r)) for x in got if x.u != want(x.b, x.r)]
    assert not wrong, (len(wrong), wrong[:8])


def test_unquoting(spark):
    texts = ["a%20b", "a+b", "100%", "%zz%41", "%C3%A9", "plain", "", "%2Bx%2b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.unquote(F.col("t")).alias("u")).collect()
    assert {x.t: x.u for x in got} == {t: unquote(t) for t in texts}


def test_links_of_a_page(spark):
    html = "<a href='/x'>1</a><a href='y/z'>2</a><a href='../up%20here'>3</a><a href='https://other/x'>4</a><a href='#top'>5</a><a href='/x'>6</a><a href='mailto:a@b'>7</a>"
    got = spark.createDataFrame([("https://h/a/b?q=1", html)], "u string, h string").select(pages.page_links(F.col("u"), F.col("h")).alias("l")).first()[0]
    assert got == ["https://h/x", "https://h/a/y/z", "https://h/up here", "https://h/a/b?q=1#top"]
