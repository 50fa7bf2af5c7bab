"""WARC archives and main text."""

from __future__ import annotations

import gzip
import random
import time

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from cairn.llm import warc
from cairn.llm.html_text import extract, main_text


def archive(spark, rows, path, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_warc(pages, path, **more)
    return manifest, warc.read_warc(spark, path)


def test_round_trip(spark, tmp_path):
    big, other = "x" * 1000, "é" * 600
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else other if i % 3 == 1 else "small", "clash") for i in range(30)]
    rows += [(40, None, None, None), (None, "http://n\r\nX: y", "", None), (50, "http://d", big, None), (50, "http://d", big, None)]
    manifest, found = archive(spark, rows, f"{tmp_path}/w", roll_bytes=700)
    got = found.collect()
    assert len(got) == len(rows) and all(r.digests_hold for r in got) and manifest.count() > 3
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([r[:3] for r in rows if r[0] not in (50, None)] + [(50, "http://d", big)], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = {r[0]: r[1:] for r in con.execute(warc.ORACLE_SQL).fetchall()}
    for r in got:
        if r.page_id not in (50, None):
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
    assert sorted(r.record_type for r in got if r.page_id == 50) == ["response", "revisit"]
    assert {r.url for r in got if r.page_id in (40, None)} == {None, "http://n%0D%0AX: y"}
    assert not [p for p in (tmp_path / "w").glob(".*.tmp")]


def test_deterministic(spark, tmp_path):
    rows = [(i, f"u{i}", "p" * (i * 37 % 1500), None) for i in range(60)]
    for name, order in (("a", rows), ("b", rows[::-1])):
        pages = spark.createDataFrame(order, "page_id long, url string, html string, digest string").repartition(3 if name == "a" else 5)
        warc.write_warc(pages, f"{tmp_path}/{name}", roll_bytes=2000)
    files = {n: {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab"}
    assert files["a"] == files["b"] and len(files["a"]) > 1
    text = b"".join(gzip.decompress(x) for _, x in sorted(files["a"].items()))
    assert text.count(b"WARC/1.1\r\n") == 60


def test_shards_follow_bytes_not_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    wide = [(i, f"u{i}", f"{i} " + "p" * 995, None) for i in range(200)] + [(1 << 60, "far", "q" * 1000, None), (-(1 << 63), "low", "r", None), ((1 << 63) - 1, "high", "s", None)]
    hot = [(None, f"n{i}", f"null {i} " + "p" * 990, None) for i in range(100)] + [(50, f"h{i}", f"hot {i} " + "p" * 990, None) for i in range(100)]
    manifest, found = archive(spark, wide + hot, f"{tmp_path}/w")
    rows = manifest.collect()
    assert 18 <= len({r.shard for r in rows}) <= 22 and max(r.records for r in rows) <= 30
    assert found.count() == 403 and found.where("not digests_hold").isEmpty()
    assert {p.name for p in (tmp_path / "w").iterdir() if not p.name.endswith(".gz")} == {"_manifest"}
    again, _ = archive(spark, (hot + wide)[::-1], f"{tmp_path}/v")
    key = lambda m: sorted((r.file, r.sha256) for r in m)
    assert key(again.collect()) == key(rows)


def test_empty(spark, tmp_path):
    manifest, found = archive(spark, [], f"{tmp_path}/w")
    assert manifest.count() == 0 and found.count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies, ok?</div>
<div class="layout"><div class="sidebar"><p>Side, bar, text.</p></div><div class="content"><h1>Title &amp; more</h1><p>One, two,   three&nbsp;four <b>bold</b>&#33;</p><p>Short.<div class="ad">Buy!</div>
<form><input></form><ul><li>item one<li>item two</ul><blockquote>said</blockquote></div><section class="comments"><p>nice, post, really, good, yes</p></section></div><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\nOne, two, three four bold!\nShort.\nitem one\nitem two\nsaid"
    assert main_text("<article><h1>A</h1><section><p>x, y</p></section><section><p>z</p></section></article><aside>q</aside>") == "A\nx, y\nz"
    assert [main_text(x) for x in (None, "", "<div>", "<p", "plain", "a < b")] == ["", "", "", "", "plain", "a < b"]


ARTICLE = "<h1>Title</h1><p>First, a paragraph of the article, with words.</p><p>Second, another one, with more words.</p>"
BODY = "Title\nFirst, a paragraph of the article, with words.\nSecond, another one, with more words."


def test_names_that_only_look_unwanted():
    wraps = ['<div class="overflow-hidden">', '<div aria-hidden="false">', '<div class="content with-sidebar">', '<div class="has-menu no-ads">', '<article><div class="article-header">', '<main class="page"><div class="post-header">', '<div id="page" data-x="hidden">', "<div class=it's title='a > b'>"]
    for wrap in wraps:
        assert main_text(f"<body><nav><a href=x>Menu</a></nav>{wrap}{ARTICLE}</div>") == BODY, wrap
    # Everything has an unwanted name: better that than nothing.
    assert main_text(f'<body><div class="sidebar">{ARTICLE}</div></body>') == BODY
    for wrap in ('<div hidden>', '<div style="display: none">', '<div aria-hidden="true">', '<div class="sidebar-left">', '<div id="siteFooter">', '<div class="post-comments">', '<section role="complementary">'):
        assert main_text(f"<body><article>{ARTICLE}</article>{wrap}<p>Not, this, one, at, all.</p></div>") == BODY, wrap
    assert main_text(f'<article>{ARTICLE}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><h2 id="related-search">More</h2></article>') == BODY + "\nSo x=1 holds.\nMore"


def test_wrapping_forms_and_titles():
    """A form around the page isn't dropped, one beside the article is; titles stand in heads; names of several words mean what they say together."""
    for wrap in ('<form id="aspnetForm" method="post"><div>', "<fieldset>", "<form><fieldset><dialog open>"):
        page = f'<body><nav><a href=x>Menu</a></nav>{wrap}{ARTICLE}<form><label>Your name and telephone number with its area code</label></form>'
        assert main_text(page) == BODY, wrap
    assert main_text(f"<body><article>{ARTICLE}</article><form><p>Write, to, us, with, your, name, and we, will, answer, you.</p></form></body>") == BODY
    rest = ARTICLE.removeprefix("<h1>Title</h1>")
    for head in ('<div class="post"><header><h1>Title</h1></header>', '<div class="head"><h1>Title</h1></div><div class="copy">'):
        assert main_text(f"<body>{head}{rest}</div></body>") == BODY, head
    assert main_text(f'<body><header><h1>The site</h1></header><div class="post"><header><h1>Title</h1></header>{rest}</div></body>') == BODY
    for name in ("side-effects", "social-policy", "search_methods", "relatedWork", "notice-period"):
        assert main_text(f'<article>{ARTICLE}<section class="{name}"><p>More of it.</p></section></article>') == BODY + "\nMore of it.", name
    for name in ("side-bar", "social-links", "search_box", "relatedPosts", "notice", "site-notice", "ad-slot", "comment-thread"):
        assert main_text(f'<article>{ARTICLE}<section class="{name}"><p>More of it.</p></section></article>') == BODY, name


def by_parser(html):
    """The text blocks of an article without anything unwanted, by the standard library's parser: another way to the same text."""
    from html.parser import HTMLParser

    blocks, held = [], []

    class Reader(HTMLParser):
        off = 0

        def cut(self):
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in ("nav", "aside", "script"):
                self.off += 1
            if tag in ("p", "h1", "h2", "li", "ul", "article", "div"):
                self.cut()
            elif tag == "br":
                held.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "li", "ul", "article", "div"):
                self.cut()
            if tag in ("nav", "aside", "script"):
                held.clear()
                self.off -= 1

        def handle_data(self, data):
            if not self.off:
                held.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.cut()
    return "\n".join(blocks)


def test_against_another_parser():
    rng = random.Random(8)
    words = ["alpha", "beta,", "x &lt; y", "&eacute;t&eacute;", "caf\u00e9", "<b>bold</b>", "<a href='u'>link</a>", "a<br>b", "&#8217;s", "<i>it</i>.", "two  spaces\n"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))
    for _ in range(200):
        parts = [f"<h1>{text()}</h1>"]
        for _ in range(rng.randint(2, 9)):
            parts.append(rng.choice([f"<p>{text()}</p>", f"<h2>{text()}</h2>", f"<ul><li>{text()}</li><li>{text()}</li></ul>", f"<div><p>{text()}</p></div>", f"<aside>{text()}</aside>", "<script>var a = '<p>';</script>"]))
        page = f"<!DOCTYPE html><html><body><nav><a>{text()}</a></nav><article>{''.join(parts)}</article><aside><p>{text()}</p></aside></body></html>"
        assert main_text(page) == by_parser(page)


def test_time_grows_with_the_page():
    for piece in ("<b>x ", "<div>x ", "<td>x ", "<li><b>x ", "<p>x<div>", "<table><tr><td>x ", "<a title=\"x>", "<select>x", "<svg>x", "<noscript><template>x ", "<object>x<form>"):
        took = []
        for n in (4000, 32000):
            start = time.thread_time()
            main_text("<article>" + piece * n)
            took.append(time.thread_time() - start)
        assert took[1] < 24 * max(took[0], 0.02), piece


def test_extract(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, None), (None, None, None, None), (2, "u", "<p>" + "long text, " * 20000 + "</p>", None)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert found.columns == ["page_id", "url", "text"]
    texts = {(r.page_id, r.text[:5], len(r.text)) for r in found.collect()}
    assert (None, "", 0) in texts and (2, "long ", 219999) in texts and found.count() == 4
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert found.where(F.col("page_id") == 1).distinct().count() == 1
