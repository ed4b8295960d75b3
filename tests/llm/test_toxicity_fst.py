"""The grammar against a direct reading of its rules; held-out accuracy; edges."""

import random

from llm_helpers import edge_rows, local_frame
from slicegauge.llm import toxicity_fst as t
from slicegauge.llm.queries import QUERIES


def by_rules(symbols, reach=3):
    """What a clause of symbols must emit, read off the rules without machines."""
    out, named, said, denied = [], False, False, 0
    for s in symbols:
        if s in "ih":
            kind = s.upper() if denied else s
            if said:
                kind = "q" if s == "i" else "Q"
            if named and kind in "ih":
                kind = {"i": "a", "h": "A"}[kind]
            out.append(kind)
        denied = reach if s == "n" else max(0, denied - 1)
        named, said = named or s == "t", said or s == "r"
    return out


def test_composed_grammar_is_its_rules():
    rnd = random.Random(2)
    for _ in range(3000):
        symbols = [rnd.choice("ihtnro") for _ in range(rnd.randrange(1, 9))]
        state, out = t.GRAMMAR.start, []
        for s in symbols:
            y, state = t.GRAMMAR.step(state, s)
            if y:
                out.append(y)
        assert out == by_rules(symbols), symbols


def test_clauses_not_words():
    model = t.ToxicityModel(words={"idiot": 4.0}, stems={"scumm": 3.0})
    f = lambda x: dict(zip(t.MATCHES, t.Reader(model).features(x)))
    assert f("You idiot!")["a"] > 0 and f("you. idiot")["i"] > 0 and f("not an idiot")["I"] > 0
    assert f("she said idiot")["q"] > 0 and f("scummiest thing")["i"] > 0 and f("I kill it")["h"] > 0
    assert not any(f("a calm day").values()) and not any(f(None).values())


def test_edges(spark, edge, nothing):
    none = local_frame(spark, [], "doc_id long, quality int, toxic int")
    out = t.judge(edge, t.fit(edge, none)).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    some = local_frame(spark, [(4, 1, 1), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert t.judge(nothing, t.fit(nothing, some)).collect() == []
    kept = t.passing(edge, t.fit(edge, none))
    assert kept.columns == edge.columns and kept.count() == len(edge_rows())
    assert sum(r.held_out for r in out) == sum(t.fold(r[0]) == 0 for r in edge_rows() if r[0] is not None)


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_toxicity_fst"](spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_a_fold_of_one_class(spark, data):
    """Whichever class the fold for the layer lacks, toxic and clean rows are still told apart."""
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.1/labels.parquet")
    fold = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 4"
    for lacking in (1, 0):
        some = labels.filter(f"NOT ({fold}) OR toxic <> {lacking}")
        out = t.judge(docs, t.fit(docs, some)).join(labels, "doc_id").filter("held_out")
        r = out.selectExpr("avg(IF(toxic = 1, predicted, NULL))", "avg(IF(toxic = 0, predicted, NULL))").first()
        assert r[0] > 0.8 and r[1] < 0.05
