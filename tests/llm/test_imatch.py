"""Fingerprints against plain sets of terms; edited texts; edges."""

import hashlib
import random
from collections import Counter

from llm_helpers import edge_rows, frame, words_of
from slicegauge.llm import imatch as m
from slicegauge.llm.base import shuffle_parts
from slicegauge.llm.queries import QUERIES


def edited_of(rows):
    """(n_chars, sha256 of the edited text) by descending id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[doc_id] = (len(text), hashlib.sha256((text[:len(text) - half] + nxt[:half]).encode()).hexdigest())
    return out


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = QUERIES["op9_imatch"](spark, data).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited_of(docs) and len(rows) == len(docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
    prints, texts = {r.doc_id: r.fingerprint for r in rows}, dict(docs)
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(t, prints[d]) == prints[d]


def test_lexicon_is_the_band(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(60) if i % (j + 1) == 0) + " THE the", "a") for i in range(200)]
    df = Counter(w for _, t, _ in rows for w in set(words_of(t.lower())))
    want = sum(4 <= n <= 20 for n in df.values())
    assert m.lexicon(frame(spark, rows), most=0.1, least=0.02).count() == want


def test_likeness_counts_agreeing_subsets(spark):
    """On a table whose terms are all in the band, likeness follows the overlap of the term sets."""
    rows = []
    for i in range(40):
        own = [f"a{i}x{j}" for j in range(120)]
        rows += [(4 * i + 3, " ".join(own), "s"), (4 * i + 2, " ".join(own), "s"), (4 * i + 1, " ".join(own[:60] + [f"b{i}x{j}" for j in range(60)]), "s"),
                 (4 * i, " ".join(f"b{i}x{j}" for j in range(120)), "s")]
    out = {r.doc_id: r.near_next for r in m.fingerprints(frame(spark, rows), most=1.0, least=0.0).collect()}
    assert all(out[4 * i + 3] == 1.0 for i in range(40))
    half = [out[4 * i + 2] for i in range(40)]
    assert 0.2 < sum(half) / len(half) < 0.5  # a third of the union is shared
    assert max(out[4 * i] for i in range(1, 40)) < 0.1


def test_edges(spark, edge, nothing):
    out = m.fingerprints(edge).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in out) == sorted((r[0] is None, r[0] or 0, len(r[1] or "")) for r in edge_rows())
    assert all(r.near_edited == 1.0 for r in out if r.n_chars == 0)
    assert m.fingerprints(nothing).collect() == []
    one = m.fingerprints(frame(spark, [(1, "only one row", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_buckets_follow_the_ids(spark):
    docs = frame(spark, [(i * i - 50, "x", "a") for i in range(100)] + [(None, "y", "a")])
    rows = docs.withColumn("b", m.order_buckets(docs, shuffle_parts(spark))).collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) > 3


def ordinary(rnd, n):
    """Texts of common words and of words each in a few hundredths of the texts."""
    common, rare = [f"the{i}" for i in range(40)], [f"w{i}" for i in range(1500)]
    return [" ".join(rnd.sample(common, 30) + rnd.sample(rare, 40)) for _ in range(n)]


def test_hot_copies_and_near_copies_keep_their_terms(spark):
    """A third of the rows are copies, or near copies, of one text; the rest are ordinary."""
    rnd = random.Random(9)
    rest, hot = ordinary(rnd, 400), ordinary(rnd, 1)[0].split() + [f"hot{i}" for i in range(60)]
    near = [" ".join(w if rnd.random() > 0.05 else f"w{rnd.randrange(1500)}" for w in hot) for _ in range(200)]
    for copies in ([" ".join(hot)] * 200, near):
        # 0-199 hot, 200-399 hot in turn with ordinary ones, 400-599 ordinary
        rows = [(i, t, "s") for i, t in enumerate(copies[:100] + [x for p in zip(copies[100:], rest) for x in p] + rest[100:])]
        out = {r.doc_id: r for r in m.fingerprints(frame(spark, rows), most=0.05, least=0.0005).collect()}
        alone = [i for i in range(100, 300) if (i - 100) % 2 == 0][1:]
        assert all(r.fingerprint for r in out.values())
        assert min(out[i].near_next for i in range(1, 100)) > 0.4
        assert max(out[i].near_next for i in alone) < 0.2
        assert sum(out[i].near_edited for i in alone) / len(alone) > 0.15  # half of the text is unchanged


def test_terms_of_two_hot_groups_differ(spark):
    """Two groups of copies side by side are not alike, and hot copies leave the others' band as it is."""
    rnd = random.Random(4)
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rest = ordinary(rnd, 200)
    plain = {t: r for t, r in zip(rest, sorted(m.fingerprints(frame(spark, [(i, t, "s") for i, t in enumerate(rest)])).collect(), key=lambda r: r.doc_id))}
    rows = [(i, t, "s") for i, t in enumerate([a, b] * 50 + rest)]
    out = {r.doc_id: r for r in m.fingerprints(frame(spark, rows)).collect()}
    assert max(out[i].near_next for i in range(1, 100)) == 0.0
    assert sum(out[100 + i].fingerprint == plain[t].fingerprint for i, t in enumerate(rest)) > 0.5 * len(rest)


def test_texts_outside_the_lexicon_differ(spark):
    rows = [(i, f"only{i} here{i}", "s") for i in range(20)] + [(20, "  ", "s"), (21, "", "s")]
    out = {r.doc_id: r for r in m.fingerprints(frame(spark, rows)).collect()}
    assert all(out[i].near_next == 0.0 and out[i].fingerprint for i in range(1, 20))
    assert out[21].near_next == 1.0 and out[21].fingerprint == "" == out[20].fingerprint
