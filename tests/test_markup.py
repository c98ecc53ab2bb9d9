"""Pages and links against hand-worked cases, the standard library's parser and its URL join."""

import random
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from brindle.functions import markup, urls
from brindle.operators.assets import asset_emails

# The reference table of RFC 3986, 5.4 (for http:g the reading that 5.2.2 allows for older links).
RFC = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
       "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x", "http:g", "https://z/../q", "//z/a/../q", "mailto:a@b", " /lead", "a//b", "a//../b", "/a//b"]


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    return [r.u for r in df.select("i", urls.absolute_url(F.col("b"), F.col("h")).alias("u")).orderBy("i").collect()]


def test_rfc_table(spark):
    pairs = [("http://a/b/c/d?q", h) for h in RFC]
    assert resolved(spark, pairs) == [urljoin(b, h) for b, h in pairs]
    want = dict(zip(RFC, resolved(spark, pairs), strict=True))
    assert want["../../../g"] == "http://a/g" and want["."] == "http://a/b/c/" and want["g?y/../x"] == "http://a/b/c/g?y/../x" and want[""] == "http://a/b/c/d?q"


def test_links_equal_the_standard_join(spark):
    rng = random.Random(3)
    pairs = [(f"https://h.example{rng.choice(['', '/', '/a', '/a/', '/a/b/c', '/a/../b/'])}", "".join(rng.choice(["/", ".", "..", "a", "b", "/../", "./"]) for _ in range(rng.randint(1, 7))) + rng.choice(["", "?q=..", "#f"])) for _ in range(1500)]
    pairs = [(b, h) for b, h in pairs if not h.startswith("//")]
    assert resolved(spark, pairs) == [urljoin(b, h) for b, h in pairs]
    assert resolved(spark, [("https://a.com/", None), (None, "/x"), ("https://a.com/b", "\n /c\td")]) == [None, None, "https://a.com/cd"]


class Parser(HTMLParser):
    """Anchors and text outside scripts, styles and comments."""

    def __init__(self):
        super().__init__()
        self.hrefs, self.words, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag == "a" and "href" in dict(attrs):
            self.hrefs.append(dict(attrs)["href"] or "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_pages_equal_the_standard_parser(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", markup.page_parts("html").alias("p")).collect()
    assert len(rows) > 20
    for r in rows:
        parser = Parser()
        parser.feed(r.html)
        parser.close()
        assert [a.href for a in r.p.links] == parser.hrefs
        assert "".join(r.p.text.split()) == "".join("".join(parser.words).split())


PAGES = {
    None: None,
    "": ("", []),
    "plain < text & 1 <2 &amp;": ("plain < text & 1 <2 &", []),
    "<a href='/1' title='a > b'>x > y</a>": ("x > y", ["/1"]),
    '<a data-x="</a>" HREF=/2>t</A>z': ("t z", ["/2"]),
    "<a href=/3?a=1&amp;b=2 href=/no>q": ("q", ["/3?a=1&b=2"]),
    "<!-- <a href=/no> --><!--><a href=/4>a</a><!---->b<!-- never <a href=/no>": ("a b", ["/4"]),
    "<script>if (a<b) '<a href=/no>'</scripty></script>c": ("c", []),
    "<SCRIPT>x</script >d<style>e</style>": ("d", []),
    "<script>never ends <a href=/no>": ("", []),
    "a<b c='never <a href=/no>": ("a", []),
    "<title>T &eacute;</title>&#233;&#xE9;&notin;&hearts;&bogus;&#0;": ("T é éé∉♥&bogus;�", []),
    "<noscript>n<a href=/5>o</a></noscript>p": ("p", ["/5"]),
    "<?php x ?></ bad><!DOCTYPE html>e</>f": ("e f", []),
    "<a>none</a><a href>empty</a>": ("none empty", [""]),
    "<textarea><a href=/no></textarea>": ("<a href=/no>", []),
}


def test_hand_worked_pages(spark):
    df = spark.createDataFrame([(h,) for h in PAGES], "h string").select("h", markup.page_parts("h").alias("p"))
    got = {r.h: r.p and (r.p.text, [a.href for a in r.p.links]) for r in df.collect()}
    assert got == PAGES


def test_forms_and_protected_addresses(spark):
    page = """<form ACTION="/a>b" method=POST><input name=q required value='"'><select name="s"></select><div data-k="hCaptcha"></div></form><input name=outside>
      <form><textarea>x</textarea><template><form><input type=Hidden name=n></form></template></form><a class="b __cf_email__" data-cfemail="2a4b6a48044549">[hidden]</a><noscript><a href="mailto:no@no.org">x</a></noscript>
      <a href=" MAILTO:Me&#64;A.org?x=1">Write to you@b.org</a>john<b>@split.org</b> test@a.org <script type="application/ld+json">{"a": "</p>"}</script>"""
    r = spark.createDataFrame([(page,)], "h string").select(markup.page_parts("h").alias("p")).select("p", markup.page_emails(F.col("p")).alias("e")).first()
    f = [(x.action, x.method, x.has_captcha, [(y.name, y.type, y.required, y.value) for y in x.fields]) for x in r.p.forms]
    assert f == [("/a>b", "post", True, [("q", "input", True, '"'), ("s", "select", False, None)]), ("", "get", False, [(None, "textarea", False, None), ("n", "hidden", False, None)]), ("", "get", False, [("n", "hidden", False, None)])]
    assert r.e == ["a@b.oc", "me@a.org", "you@b.org"]
    assert r.p.json_ld == ['{"a": "</p>"}']


@pytest.mark.parametrize("unit", ["<", "<a ", "<a href='", "<!--", "<script>", "<a b=\"c\" ", "&", "</", "<form>", "<![", "x<y"])
def test_long_pages_cost_their_length(unit):
    times = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        markup.read_page(unit * n)
        times.append(time.perf_counter() - start)
    assert times[1] < 1 or times[1] < 10 * times[0]


def test_assets(spark):
    html = "<script src=a.js></script><script src='//www.S.org/b.MJS?v'></script><script src=https://cdn.org/c.js></script><script src=a.js></script><link rel='modulepreload' href=../d.json><link rel=icon href=/e.css><link rel=Stylesheet href=/f.css><script src=/g.js></script>"
    pages = spark.createDataFrame([(1, "https://s.org/x/y", html), (2, "https://other.org/", "<script src=/none.js></script>"), (3, None, html), (4, "https://s.org/", None)], "page_id int, url string, html string")
    pages = pages.select("page_id", "url", markup.page_parts("html").alias("parts"))
    at = lambda path, t, status, kind, body: ("https://s.org" + path, t, status, kind, body)
    fetches = spark.createDataFrame([
        at("/x/a.js", 1, 200, "text/plain", "old@s.org"), at("/x/a.js", 2, 200, "application/javascript", "New&#64;s.org and x@gmail.com x@else.org test@s.org"), at("/g.js", 1, 404, "text/css", "lost@s.org"), at("/d.json", 1, 200, "image/png", "no@s.org"),
        ("https://www.S.org/b.MJS?v", 1, 200, "TEXT/x", "sub@mail.s.org &commat;"), at("/f.css", 1, 200, "text/css", "fifth@s.org"), (None, 1, 200, "text/css", "null@s.org"), ("https://other.org/none.js", 1, 200, "text/css", None),
    ], "asset_url string, fetched_at int, status_code int, content_type string, body string")
    first = {r.page_id: r.a for r in pages.select("page_id", markup.first_assets(F.col("url"), F.col("parts")).alias("a")).collect()}
    assert first[1] == ["https://s.org/x/a.js", "https://www.S.org/b.MJS?v", "https://s.org/g.js", "https://s.org/d.json"]
    got = {r.page_id: (r.n_assets, r.n_read, r.emails) for r in asset_emails(pages, fetches).collect()}
    assert got == {1: (4, 2, ["new@s.org", "sub@mail.s.org", "x@gmail.com"]), 2: (1, 1, []), 3: (0, 0, []), 4: (0, 0, [])}
    assert asset_emails(pages.limit(0), fetches).count() == 0 and {r.n_read for r in asset_emails(pages, fetches.limit(0)).collect()} == {0}
