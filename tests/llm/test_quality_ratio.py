"""Statistics and ratio against plain Python; verdicts on labelled documents."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from llm_helpers import edge_rows, frame, local_frame, words_of
from slicegauge.llm import quality_ratio as q
from slicegauge.llm.queries import QUERIES


def slow_statistics(text):
    w = words_of(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dup, seen = 0, set()
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_statistics_match_plain_python(spark, edge, data):
    texts = [r[1] for r in edge_rows()] + ["# | #\n \n# | #", "a a a a", "a b c a b c d a b c"]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 150").collect()]
    for t in texts:
        assert q.statistics(t) == slow_statistics(t)


def buckets_of(words, buckets):
    mask = (1 << 64) - 1
    h = [zlib.crc32(w.encode()) for w in words]
    one = [(x * 0xC4CEB9FE1A85EC53 & mask) >> 40 for x in h]
    two = [((a * 0x9E3779B1 + b + 0x7F4A7C15 & mask) * 0xFF51AFD7ED558CCD & mask) >> 40 for a, b in zip(h, h[1:])]
    return [x % buckets for x in one + two]


def test_ratio_against_plain_counts(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("Aa bb cc dd ee ff gg hh".split()) for _ in range(rnd.randrange(0, 90))), "s") for i in range(40)]
    labels = local_frame(spark, [(i, i % 2, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int")
    docs, n = frame(spark, rows), 64
    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        b = buckets_of(words_of(t.lower()), n)
        raw.update(b)
        if i % 3 == 0 and i % 2 == 1:
            target.update(b)
    lp = lambda c, x: math.log(c[x] + 1) - math.log(sum(c.values()) + n)
    got = {r.doc_id: r for r in q.judge(docs, q.fit(docs, q.trusted_sample(labels), buckets=n)).collect()}
    for i, t, _ in rows:
        b = buckets_of(words_of(t.lower()), n)
        want = sum(lp(target, x) - lp(raw, x) for x in b) / len(b) if b else None
        assert got[i].score == (pytest.approx(want, abs=1e-9) if b else None)
        assert got[i].base_failed == (len(words_of(t)) < 50 or 100 * got[i].n_repeat_words > 50 * got[i].n_words)


def test_edges(spark, edge, nothing):
    none = local_frame(spark, [], "doc_id long, quality int, toxic int")
    model = q.fit(edge, q.trusted_sample(none))
    assert not model.log_ratio.any()
    out = q.judge(edge, model).collect()
    assert len(out) == len(edge_rows())
    assert all(r.base_failed and not r.kept and r.score is None for r in out if not r.n_words)
    assert q.judge(nothing, q.fit(nothing, q.trusted_sample(none))).collect() == []
    assert q.passing(edge, model).columns == edge.columns
    assert sorted(r.doc_id for r in q.passing(edge, model).collect()) == sorted(r.doc_id for r in out if r.kept)


def test_labelled_documents(spark, data):
    out = QUERIES["op5_quality_ratio"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("size, trusted, lost, junk", [("sf0.001", 35, 0.2, 0.5), ("sf0.01", 160, 0.1, 0.1), ("sf0.1", 300, 0.02, 0.1)])
def test_good_documents_left_out_of_the_target(spark, size, trusted, lost, junk):
    """With few labels good documents the target has not seen are kept, in every language, and bad ones are not."""
    folder = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = q.trusted_sample(labels, trusted)
    ids = {r.doc_id for r in seen.collect()}
    out = q.judge(docs, q.fit(docs, seen)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("NOT base_failed").collect()
    bad = [r.kept for r in out if r.quality == 0]
    good = [(r.lang, r.kept) for r in out if r.quality == 1 and r.doc_id not in ids]
    assert sum(not k for _, k in good) <= lost * len(good) and sum(bad) <= junk * len(bad)
    for lang, n in Counter(x for x, _ in good).items():
        if n >= 20:
            assert sum(k for x, k in good if x == lang) >= 0.75 * n
