"""Rules and features against plain Python; training edges."""

import math
from collections import Counter

from llm_helpers import local_frame
from slicegauge.llm import url_trees as u
from slicegauge.llm.queries import QUERIES, URL_RULES

URLS = [None, "", "nothing", "http://", "https://A.Example.COM/en/1?x=1&y=2#f", "http://www.example.com/en/", "http://WWW.example.com", "http://x.net/es/",
        "http://net/fr/a", "http://xnet/fr/a", "http://a.b.example.org/p//q?u=http://c.com/", "ftp://h#frag/", "http://h?q/", "https://É.com/é/", "http://example.com/en"]


def slow(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def slow_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


def check(rows):
    for r in rows:
        assert (r.host, r.path) == slow(r.url)
        rule = slow_rule(r.host, r.path)
        assert r.rule == (rule.text if rule else None) and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == rule.verdict


def test_whole_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    out = QUERIES["op10_url_trees"](spark, data)
    rows = out.join(pages, "page_id").collect()
    assert len(rows) == pages.count() == out.count()
    check(rows)
    known = [r for r in rows if r.rule]
    assert sum((r.block_score >= 0.5) == (r.verdict == "block") for r in known) >= 0.8 * len(known)
    assert len({r.block_score for r in rows}) > 10


def test_edges(spark):
    schema = "page_id long, url string, host int, path int, label int, suffix string"
    pages = local_frame(spark, [(i, x, 1, 2, 3, "s") for i, x in enumerate(URLS + URLS[4:6])] + [(None, None, 1, 2, 3, "s")], schema)
    urls = u.with_rule(pages.select("page_id", "url"), URL_RULES)
    none = urls.selectExpr("url", "host", "path", "CAST(NULL AS INT) AS label")
    rows = u.judge(urls, u.fit(none, urls)).collect()
    assert len(rows) == len(URLS) + 3
    check(rows)
    assert all(r.verdict == "allow" for r in rows if not r.rule)
    blocked = u.judge(urls, u.fit(none.selectExpr("url", "host", "path", "1 AS label"), urls)).collect()
    assert all(r.verdict == "block" for r in blocked if not r.rule)
    empty = urls.filter("false")
    assert u.judge(empty, u.fit(none.filter("false"), empty)).collect() == []


def test_features(spark):
    rows = u.lexical(u.with_rule(local_frame(spark, list(enumerate(URLS)), "page_id long, url string"), URL_RULES)).collect()

    def bits(text):
        n = Counter(text)
        return -sum(c / len(text) * math.log2(c / len(text)) for c in n.values()) if text else 0.0

    for r in rows:
        url = r.url or ""
        query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
        assert r.url_length == len(url) and r.depth == r.path.count("/") and r.labels == r.host.count(".") + 1
        assert math.isclose(r.host_entropy, bits(r.host), abs_tol=1e-9) and math.isclose(r.path_entropy, bits(r.path), abs_tol=1e-9)
        assert r.parameters == (query.count("&") + 1 if query else 0)
        assert math.isclose(r.digit_ratio, sum(c in "0123456789" for c in url) / max(1, len(url)))


def test_trees_learn_the_form(spark):
    """Held-out urls with digits and long hosts are told from plain ones."""
    rows = [(i, f"http://{'cheap-win%d' % (i * 37 % 91) if i % 2 else 'news'}.org/{'x' * (i % 5)}", i % 2) for i in range(400)]
    urls = u.with_rule(local_frame(spark, rows, "page_id long, url string, label int"), [])
    out = u.judge(urls.filter("page_id >= 300"), u.fit(urls.filter("page_id < 300"), urls)).collect()
    assert sum((r.verdict == "block") == bool(r.label) for r in out) >= 98


def test_unlabelled_suffix_is_judged_by_form(spark):
    """A suffix that only blocked urls have says nothing of one that no label has."""
    def url(i, suffix, bad):
        return i, f"http://{'cheap-win%d' % (i * 37 % 91) if bad else 'news'}.{suffix}/{'x' * (i % 5)}", int(bad)

    rows = [url(i, "net" if i % 4 == 0 else "com", i % 4 < 2) for i in range(400)] + [url(i, "org", i % 2) for i in range(400, 600)]
    urls = u.with_rule(local_frame(spark, rows, "page_id long, url string, label int"), [])
    out = u.judge(urls.filter("page_id >= 400"), u.fit(urls.filter("page_id < 400"), urls)).collect()
    assert sum((r.verdict == "block") == bool(r.label) for r in out) >= 196
