import base64
import hashlib
import html
import re
import time

import pytest

from spanloom.llm import warc
from spanloom.llm.main_text import extract_main_text, main_text
from spanloom.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><h1>Head &amp; more</h1><p>First <b>bold</b> line
 goes on&nbsp;here.<p>Second&#8217;s <a href="/x">link</a> in a longer sentence that says a good deal.</p><form><p>Your mail</p><input></form><script>var x = "<p>no</p>";</script>
<ul><li>One item</li><li>Two items</li></ul></article><aside>Related things</aside><section id="comments"><p>I agree, said the reader.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "Head & more\nFirst bold line goes on here.\nSecond’s link in a longer sentence that says a good deal.\nOne item\nTwo items"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "&#0;", "<div>" * 3000, "<p>a" * 3000, "</div></p>", "<a" * 500, "\x00"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(main_text(page), str)


def test_unmarked_page_by_density():
    long = "This is a long line of real prose that goes on for a good while and has no links in it at all. "
    page = "<body>" + "".join(f'<div><a href="/{i}">link {i}</a></div>' for i in range(12)) + f"<div>{long * 3}</div><div>{long * 2}</div>" + "".join(f'<span><a href="/{i}">more {i}</a></span><br>' for i in range(12)) + "</body>"
    got = main_text(page)
    assert got.split("\n") == [(long * 3).strip(), (long * 2).strip()]


def test_the_ratio_decides_on_the_given_pages(spark):
    """Menus are told by their text-to-tag ratio alone; without it they are content on every page that has one."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        with_ratio, without = main_text(r["html"]), main_text(r["html"], ratio=False)
        links = [" ".join(html.unescape(x).split()) for x in re.findall(r"<li><a href=[^>]*>([^<]*)</a></li>", r["html"].split("<article")[0])]
        assert (with_ratio != without) == bool(links)
        assert without.split("\n")[: len(links)] == links and not (links and with_ratio.startswith("\n".join(links[:4]) + "\n"))


def test_articles_equal_a_plain_reading(spark):
    """The given pages mark their article: its text, read by regular expressions."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"<(?:script|style)\b.*?</(?:script|style)>|<form\b.*?</form>|<!--.*?-->", "", body, flags=re.S)
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote|table|tr|td|pre)\b[^>]*>", body)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
        assert main_text(r["html"]) == "\n".join(x for x in plain if x)


@pytest.mark.parametrize("page", ["<div>{}x", "<b><div><i>{}</b>", "<ul><li><div>{}x", "<p><b>{}x", "<table><tr><td>{}x"])
def test_deep_pages_take_linear_time(page):
    def took(n):
        head, tail = page.split("{}")
        began = time.perf_counter()
        main_text(head * n + tail * n)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 12 * max(took(4_000), 0.01)


def test_nothing_is_cut_from_long_pages():
    text = "word " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_rows_of_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", len(main_text(PAGE)))] * 2 + [(2, None, 0), (None, "v", 0)]
    assert extract_main_text(df.where("false")).count() == 0


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_derivatives(spark):
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n", "<title>T é</title><p>caf\xe9</p><a href='/x'>y</a>".encode("latin-1")), ("<urn:uuid:2>", None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload binary")
    got = warc.build_derivatives(df.unionByName(df)).collect()
    assert len(got) == 8 and len({r["record_id"] for r in got}) == 4
    first = {r["record_type"]: r for r in got if r["refers_to"] == "<urn:uuid:1>"}
    assert first["conversion"]["block"] == "T é\ncafé\ny" or first["conversion"]["block"].endswith("café\ny")
    assert "outlink: /x" in first["metadata"]["block"] and first["conversion"]["record_id"] in first["metadata"]["block"] and "charset: iso-8859-1" in first["metadata"]["block"]
    for r in got:
        assert r["block_digest"] == sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    assert {r["payload_digest"] for r in got if r["refers_to"] == "<urn:uuid:1>"} == {sha1(rows[0][4])}
    assert [r["block"] for r in got if r["refers_to"] == "<urn:uuid:2>" and r["record_type"] == "conversion"] == ["", ""]
    assert warc.build_derivatives(df.where("false")).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_round_trip(spark, tmp_path, compression):
    records = QUERIES["op1_warc_derivatives"](spark, "/root/testdata/sf0.001")
    warc.write_warc(records, str(tmp_path / "w"), compression)
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    made = records.collect()
    assert len(back) == len(made)
    for r in made:
        b = back[r["record_id"]]
        assert bytes(b["block"]).decode() == r["block"]
        assert all(b[c] == r[c] for c in ("record_type", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "source_headers"))


def test_blocks_may_hold_the_beginning_of_a_record(spark, tmp_path):
    page = "<p>WARC/1.1 is a format\r\n\r\nWARC/1.0 was one</p>"
    df = spark.createDataFrame([(f"<urn:{i}>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nA: b\r\n", page, 1, "x") for i in range(3)], "record_id string, target_uri string, date string, http_headers string, payload string, block int, record_type string")
    made = warc.build_derivatives(df)
    warc.write_warc(made, str(tmp_path / "w"))
    key = lambda r: (r["record_id"], r["source_headers"], bytes(r["block"]) if not isinstance(r["block"], str) else r["block"].encode())
    assert sorted(map(key, warc.read_warc(spark, str(tmp_path / "w")).collect())) == sorted(map(key, made.collect()))
    (tmp_path / "bad").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_visible_text_equals_a_plain_parser(spark):
    """On the given pages: all text of the body, a line for each block."""
    from html.parser import HTMLParser

    blocks = set("article div h1 h2 h3 p ul ol li nav footer header aside section body br form table tr td".split())

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [""], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head")
            self.out += [""] if tag in blocks else []

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head")
            self.out += [""] if tag in blocks else []

        def handle_data(self, data):
            if not self.skip:
                self.out[-1] += data

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = Plain()
        plain.feed(r["html"])
        assert warc.visible_text(r["html"]) == "\n".join(x for x in (" ".join(o.split()) for o in plain.out) if x)


@pytest.mark.parametrize("page", ["<a ", "<script ", "<title>", "<html ", "<p ", "<!--", "<a href=", "<head>", "word "])
def test_long_pages_take_linear_time(page):
    def took(n):
        began = time.perf_counter()
        warc.derivatives("<urn:1>", "u", "d", "", (page * n).encode())
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 12 * max(took(20_000), 0.01)
