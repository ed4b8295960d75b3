"""Personal data: base rules against the plain patterns, messages against enumeration, and what the field adds."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from llm_helpers import DOCS, edge_rows, frame, local_frame
from slicegauge.llm import pii_crf
from slicegauge.llm.queries import QUERIES

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or "", re.ASCII):
            s = m.group()
            digits = [int(c) for c in s if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card":
                doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


HARD = ["a@b.c@d.e @b.c@d.e x@y", "a@b..c a@b.c- a.b%+-@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0004 1.2.3.4", "4068516892505468", "4068 5168-9250 5468 1",
        "7536784127813050 4845168114407329", "+1 (136) 555-7479 +1 +12 3 +1.......... +123456789012345 6", "é+1 (136) 555-7479@é.com x@é.com", "٣٣.1.1.1 1.1.1.٣",
        "+1" + " " * 500 + "(", "a" * 5000 + "@", "1" * 5000, "@" * 500 + "a.b", "", "0.0.0.0@a.b 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"]


def test_base_spans_are_those_of_the_plain_patterns(spark, data):
    texts = HARD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("@.a1 +-()25"), 60)) for _ in range(2_000)]
    for t in texts:
        assert [f"{pii_crf.KINDS[k]}:{i}:{j}" for i, k, j in pii_crf.base_spans(t)] == plain_base(t), t


def enumerated(unary, edges, pairs):
    n, k = unary.shape
    p = np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(ys)) + sum(pairs[t][ys[u], ys[v]] for u, v, t in edges))
        for i, y in enumerate(ys):
            p[i, y] += w
    return p / p.sum(1, keepdims=True)


def test_messages_against_enumeration():
    rng = np.random.default_rng(1)
    pairs = rng.normal(0, 1, (2, 4, 4))
    unary = rng.normal(0, 1, (6, 4))
    tree = np.array([(0, 1, 0), (1, 2, 0), (1, 4, 1), (3, 4, 0), (5, 0, 1)])
    assert np.abs(pii_crf.marginals(unary, tree, pairs, 60) - enumerated(unary, tree, pairs)).max() < 1e-6
    loop = np.array([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (4, 5, 1)])
    assert np.abs(pii_crf.marginals(unary, loop, 0.5 * pairs, 60) - enumerated(unary, loop, 0.5 * pairs)).max() < 0.05


@pytest.fixture(scope="module")
def model(spark, data):
    return pii_crf.fit(spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.1/documents.parquet"))


def spans_of(spark, model, texts):
    rows = pii_crf.find(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()
    return [[x for x in r.spans.split(",") if x] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_field_adds_what_the_rules_miss(spark, model):
    cards = "we paid 7536784127813050 4845168114407329 today"
    phone = "call +1 (136) 555-7479 now or later (136) 555-7479 again"
    email = "write to lyhe.24@mail4.example.com and ask for lyhe.24 there"
    clean = "chapter 12 of 1999 has 3 parts, version 2.0 and page 555 or room 7479"
    secret = 'token = "254a3ed195c502ef96b5857aa82e5fbcfb6b6856" and 6914592418178720'
    got = spans_of(spark, model, [cards, phone, email, clean, secret])
    assert [x for x in got[0] if x.startswith("card")] == ["card:8:24", "card:25:41"]
    assert got[1][0] == plain_base(phone)[0] and any(x.startswith("phone") and int(x.split(":")[1]) > 20 for x in got[1][1:])
    assert got[2][0] == plain_base(email)[0]
    assert got[3] == [] and got[4] == []


def test_skip_edges_carry_labels(model):
    """The lone second half of a number is told apart from an equal-looking one only by the mention it repeats."""
    probs = []
    for text in ("ring +1 (136) 555-7479 xx yy 555-7479 zz", "ring +1 (136) 555-7479 xx yy 555-7111 zz"):
        g = pii_crf.graph(text, pii_crf.base_spans(text))
        unary, label = model.unary(g.features), np.array(g.label)
        unary[label >= 0] = np.where(np.arange(pii_crf.OTHER + 1)[None] == label[label >= 0, None], 0.0, -30.0)
        probs.append(pii_crf.marginals(unary, np.array(g.edges).reshape(-1, 3), model.pairs)[-1, 3])
    assert probs[0] > probs[1] + 0.02 or probs[0] > 0.99


def test_query_and_edges(spark, data, model, nothing):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    df = QUERIES["op13_skip_chain_pii"](spark, data)
    assert df.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    extra = 0
    for r in rows:
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k, _ in PLAIN]
        spans = [x for x in r.spans.split(",") if x]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii_crf.KINDS.index(x.split(":")[0])))
        extra += len(spans) - len(base)
        if not base:
            assert not spans or re.search("[0-9@]", docs[r.doc_id])
    assert extra <= 0.1 * sum(len(plain_base(t)) for t in docs.values())
    edge = local_frame(spark, edge_rows() + [(i, t, "en", "s", 0, "n", 1, 2, 3, "s") for i, t in enumerate(HARD * 2)], DOCS)
    assert pii_crf.find(edge, model).count() == len(edge_rows()) + 2 * len(HARD)
    assert pii_crf.find(nothing, pii_crf.fit(nothing)).collect() == []
    same = pii_crf.fit(edge), pii_crf.fit(edge.repartition(5))
    assert np.array_equal(same[0].weights, same[1].weights)
