"""Phrase mining against counting everything in plain Python, and against SQL."""

import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from compare import connect, oracle_rows, spark_rows, type_gaps
from llm_helpers import DOCS, edge_rows, local_frame, lower_az
from slicegauge.llm import collocations
from slicegauge.llm.queries import ORACLES, QUERIES


def brute(rows, support, longest, limit, covered):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower_az(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= support}
        covered_by = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered_by[p[i:i + m]] = max(covered_by[p[i:i + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * covered_by[p] >= covered * a and covered_by[p]:
                continue
            cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode("utf-8"), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("covered", [100, 70])
def test_against_counting_everything(spark, data, covered):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(5)
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = collocations.collocations(docs, 30, 4, 150, covered, shard_words=9_000, shard_bytes=1 << 16)
    want = brute(rows, 30, 4, 150, covered)
    assert len(want) > 100 and result(got) == want


def test_union_holds_every_frequent_phrase(spark, data):
    """Lowered support in any number of shards loses nothing, and many candidates are ruled out by what may be untold."""
    texts = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").repartition(6).cache()
    totals = {r.lang: r.n for r in texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    exact = {r.hash for r in collocations.candidates(texts.coalesce(1), totals, 60, 3, 10**7, 0).collect()}
    for local, words in ((2, 20_000), (0, 20_000), (9, 5_000)):
        got = {r.hash for r in collocations.candidates(texts, totals, 60, 3, words, local).collect()}
        assert exact <= got and len(got) < 8 * len(exact)
    assert len(exact) > 200


def told(rows, words, support, local, share):
    """What one task of the first pass tells of `rows` in shards of `words`: untold by language, excess by (language, hash)."""
    import pyarrow as pa
    totals = Counter()
    for t, lang in rows:
        totals[lang] += share * len((t or "").encode())
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": lang} for t, lang in rows], pa.schema([("text", pa.string()), ("lang", pa.string())]))
    got = [r for b in collocations._mine(SimpleNamespace(value=totals), support, 4, words, local)([batch]) for r in b.to_pylist()]
    return {r["lang"]: r["excess"] for r in got if r["hash"] is None}, {(r["lang"], r["hash"]): r["excess"] for r in got if r["hash"] is not None}


def test_shards_of_a_task_tell_together(spark, data, monkeypatch, tmp_path):
    """every shard told for itself; with more shards than the support each told every phrase it had."""
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rows = [(r.text, r.lang or "und") for r in spark.read.parquet(f"{data}/documents.parquet").limit(400).collect()]
    one, many = told(rows, 10**9, 100, 2, 33), told(rows, 2_000, 100, 2, 33)
    assert one == many and set(one[0].values()) == {2} and len(one[1]) > 1_000
    phrases = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower_az(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            phrases.update((lang, *w[i:i + k]) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    assert sorted(n - 2 for n in phrases.values() if n > 2) == sorted(one[1].values())
    assert told([], 100, 100, 2, 33) == ({}, {}) and told([("", "en"), (None, "de")], 100, 100, 2, 33) == ({"en": 0, "de": 0}, {})
    assert not list(tmp_path.iterdir())


def test_few_tasks_may_leave_more_untold():
    assert collocations.tellers(100, 2) == 33 and 33 * 2 < 100
    assert collocations.tellers(100, 0) == 99 and collocations.tellers(20, 2) == 0


def test_support_reached_by_untold_counts_alone(spark):
    """A phrase at the support in one task with a support no higher than `local` was told by none."""
    docs = local_frame(spark, [(i, "a b", "en", "s", 0, "n", 1, 2, 3, "s") for i in range(2)], DOCS).coalesce(1)
    for support in (1, 2):
        assert {(r.phrase, r.n) for r in collocations.frequent(docs, support, 2).collect()} == {("", 4), ("a", 2), ("b", 2), ("a b", 2)}


def test_bit_set_grows_with_the_union(spark):
    codes = spark.range(600_000).selectExpr("xxhash64(id) AS hash")
    for most, size, share in ((24, 24, 0.01), (27, 25, 0.003)):
        bits = collocations.bit_set(codes, most)
        assert len(bits) == 1 << (size - 6)
        assert collocations.in_set(bits, np.array([r.hash for r in codes.limit(1000).collect()], np.int64).view(np.uint64)).all()
        assert collocations.in_set(bits, np.random.default_rng(1).integers(0, 2**64, 100_000, np.uint64)).mean() < share


def test_shards_never_change_counts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, many = [{(r.lang, r.phrase): r.n for r in collocations.frequent(docs.repartition(k), 40, 3, words, 1 << 14).collect()}
                 for k, words in ((1, 10**7), (16, 2_000))]
    assert one == many and len(one) > 100


def test_edges(spark, nothing):
    assert collocations.collocations(nothing).collect() == []
    texts = [None, "", " .,\n ", "A b, a B. a b\ta\x0bb!a b", "a b a b a b", "É b\x00c é b\x00c " * 2, "a b a b a b", "漢 字 漢 字;漢 字", "ſ K a b"]
    rows = [(i, t, lang, "s", 0, "n", 1, 2, 3, "s") for i, (t, lang) in enumerate((t, x) for t in texts for x in ("en", None, "und", "de"))]
    rows += edge_rows()
    docs = local_frame(spark, rows, DOCS)
    for support in (1, 2, 3):
        got = collocations.collocations(docs.filter("doc_id <> 5 AND doc_id <> 13 OR doc_id IS NULL"), support, 5, 10_000)
        assert result(got) == brute([(r[1], r[2]) for r in rows if r[0] not in (5, 13)], support, 5, 10_000, 100)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 11)],
                                   "lang string, phrase string, size int, n long")
    row = collocations.scored(counts).first()
    assert row.score == 1000 * (big - 11) * 9 * big // (big * (big + 7)) and (row.l, row.r) == (big, big + 7)


def test_query_against_sql(spark, data):
    con, sql = connect(data), ORACLES["op11_son_collocations"]
    df = QUERIES["op11_son_collocations"](spark, data)
    assert spark_rows(df) == oracle_rows(con, sql) and type_gaps(df, con, sql) == {}
