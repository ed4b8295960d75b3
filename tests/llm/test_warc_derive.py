"""Records read back by their own headers; text, links and digests; edges."""

import base64
import gzip
import hashlib
import re
import time
import zlib
from html.parser import HTMLParser

import pytest
from llm_helpers import local_frame
from slicegauge.llm import warc_derive as w
from slicegauge.llm.queries import QUERIES

PAGE = ("<!DOCTYPE html><html lang='de'><head><title>A &amp; B\n c</title><style>p{}</style><script>var x='</p><a href=\"/no\">'</script></head>"
        "<body><!-- <a href='/hidden'>h</a> --><p>One <b>bold</b>&nbsp;word<br>next</p><div>2 &lt; 3</div><a href='/a?x=1&amp;y=2'>l</a><A HREF=b.html>m</A></body></html>")


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Reader(HTMLParser):
    """The text by the standard library's parser instead of patterns."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.skip = "", 0

    def _tag(self, tag):
        if re.fullmatch("p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|title|body|main|aside|br", tag):
            self.text += "\n"

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template")
        self._tag(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template")
        self._tag(tag)

    def handle_data(self, data):
        if not self.skip:
            self.text += data.replace("\n", " ")

    def handle_comment(self, data):
        self.text += " "


def words_of(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return [x.split() for x in reader.text.split("\n") if x.strip()]


def record(headers, payload):
    block = b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + payload
    return w.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(block)))], block)


CHUNKED = b"4;x=y\r\n<p>o\r\n5\r\nne</p\r\n1\r\n>\r\n0\r\nTrailer: t\r\n\r\n"


@pytest.mark.parametrize("headers, payload, error", [
    (b"Content-Encoding: gzip", gzip.compress(b"<p>one</p>"), None),
    (b"Content-Encoding: GZIP", gzip.compress(b"<p>o") + gzip.compress(b"ne</p>"), None),
    (b"Content-Encoding: deflate", zlib.compress(b"<p>one</p>"), None),
    (b"Content-Encoding: deflate", zlib.compress(b"<p>one</p>")[2:-4], None),
    (b"Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(b"<p>one</p>")), None),
    (b"Content-Encoding: gzip", b"<p>one</p>", None),
    (b"Transfer-Encoding: chunked", CHUNKED, None),
    (b"Transfer-Encoding: chunked", b"<p>one</p>", None),
    (b"Content-Encoding: gzip", gzip.compress(b"<p>one</p>")[:-9], "ends early"),
    (b"Content-Encoding: br", b"abc", "not known"),
])
def test_codings(headers, payload, error):
    meta, conv = w.derivatives(1, record(headers, payload))
    assert (conv[12], conv[13]) == ("one", None) if error is None else error in conv[13] and conv[12] == ""
    assert conv[3] == meta[3] == "<urn:x>"


def test_codings_bound_and_headers():
    with pytest.raises(ValueError, match="more than 1000"):
        w.inflated(gzip.compress(b"x" * 5000), "gzip", 1000)
    assert w.inflated(gzip.compress(b"x" * 1000), "gzip", 1000) == b"x" * 1000
    meta, _ = w.derivatives(1, record(b"Set-Cookie: a=1\r\nLink: <b>\r\nset-cookie: b=2\r\n c", b""))
    assert "http-set-cookie: a=1\r\nhttp-link: <b>\r\nhttp-set-cookie: b=2 c\r\n" in meta[12]
    assert b"WARC-Refers-To" not in w.derivatives(1, b"junk")[0][14]


@pytest.mark.parametrize("piece", ["<script ", "<!--", "<title>", "<title", "<a ", "<html ", "<", "<p", "< <p>", "<br   ", "<a href='", "<style>x</style"])
def test_markup_without_end_takes_linear_time(piece):
    page = piece * 100_000
    start = time.process_time()
    w.plain_text(page)
    w.facts(page, "http://a/")
    w.facts(page + ">", "http://a/")
    assert time.process_time() - start < 3


def test_text_and_facts():
    assert w.plain_text(PAGE).split("\n") == ["A & B c", "One bold\xa0word", "next", "2 < 3", "lm"]
    assert w.facts(PAGE, "http://h.org/d/e") == [("title", "A & B c"), ("language", "de"), ("outlink", "http://h.org/a?x=1&y=2"), ("outlink", "http://h.org/d/b.html")]


def test_whole_table(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES["op6_warc_derive"](spark, data).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == sorted((p, k) for p in pages for k in ("conversion", "metadata"))
    for r in rows:
        page = pages[r.page_id]
        headers, block = w.parse(bytes(r.record))
        source, _ = w.parse(w.response(r.page_id, page.url, page.html))
        assert block == r.content.encode() and headers["warc-block-digest"] == r.block_digest == sha(block)
        assert headers["warc-refers-to"] == r.refers_to == source["warc-record-id"] and headers["warc-target-uri"] == page.url
        assert r.source_payload_digest == sha(page.html.encode()) and headers["warc-record-id"] == r.record_id and r.error is None
        assert headers["warc-date"] == headers["warc-refers-to-date"] == source["warc-date"]
        if r.record_type == "conversion":
            assert [x.split() for x in r.content.split("\n") if x] == words_of(page.html)
        else:
            assert "http-content-type: text/html; charset=utf-8\r\n" in r.content
    assert len({r.record_id for r in rows}) == len(rows)


def test_edges(spark):
    schema = "page_id long, url string, html string, record int, error string"
    pages = local_frame(spark, [(1, None, None, 1, "e"), (2, "http://a/\r\nX: y", "", 1, "e"), (None, "u", "<p>x", 1, "e"), (3, "http://[", "<a href='//['>t</a>", 1, "e"),
                                (4, "u", "long " * 200_000, 1, "e"), (5, "u", "same", 1, "e"), (5, "u", "same", 1, "e")], schema)
    rows = w.derive(w.responses(pages)).collect()
    assert len(rows) == 14 and all(r.error is None for r in rows)
    text = {(r.page_id, r.content_length) for r in rows if r.record_type == "conversion"}
    assert (1, 0) in text and (2, 0) in text and (None, 1) in text and (4, 999_999) in text
    assert w.derive(w.responses(pages.filter("false"))).collect() == []


def test_damaged_records_are_reported(spark):
    good = w.response(1, "http://a/", "<p>text</p>")
    bad = [None, b"", b"junk", good[:-20], good.replace(b"<p>text", b"<p>tent"), good.replace(b"WARC-Type: response", b"WARC-Type: request"), good]
    rows = w.derive(local_frame(spark, list(enumerate(bad)), "page_id long, record binary")).collect()
    assert all((r.error is None) == (r.page_id == 6) for r in rows)
    assert all(r.content == "" for r in rows if r.page_id != 6 and r.record_type == "conversion")
    utf16 = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-A: b\r\n c\r\n\r\n" + "<p>é</p>".encode("latin-1")
    raw = w.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(utf16)))], utf16)
    meta, conv = w.derivatives(1, raw)
    assert conv[12] == "é" and "http-x-a: b c\r\n" in meta[12] and conv[3] == "<urn:x>"
