"""Targets and draws against plain Python; the mix on labelled sources; edges."""

import math
from collections import defaultdict
from fractions import Fraction

import pytest

from llm_helpers import edge_rows, frame, local_frame, words_of
from slicegauge.llm import pareto_mix as p
from slicegauge.llm.queries import QUERIES


def slow_targets(sizes, shares=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: Fraction(shares[i % len(shares)]) for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        out = {s: Fraction(cap * sizes[s]) if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if out[s] > cap * sizes[s]}
        if not over:
            return {s: float(x) for s, x in out.items()}
        capped |= over


def check(rows, sizes_by_source, near):
    want, taken = slow_targets(sizes_by_source), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes_by_source[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near(s)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in docs:
        n = len(words_of(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    rows = QUERIES["op1_pareto_mix"](spark, data).collect()
    assert len(rows) == len(docs)
    check(rows, sizes, lambda s: max(2, 0.02 * slow_targets(sizes)[s]))
    again = QUERIES["op1_pareto_mix"](spark, data).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_sample_follows_the_pareto_order(spark):
    """Certain copies first, then a prefix of the ranking by random over inclusion odds, but for the closing rows."""
    rows = p.measure(frame(spark, [(i, "w " * (1 + i % 40), "ab"[i % 3 == 0]) for i in range(600)]))
    cut = p.cuts(rows, p.targets(rows))
    goals = {r["_s"]: r for r in cut.collect()}
    out = p.mix(rows, cut, size="size", bits="draw").collect()
    for source, g in goals.items():
        mine = []
        for r in (r for r in out if r.source == source):
            u = (((r.draw & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)
            mine.append((u / (1 - u) / ((r["size"] + 0.001) / (r["size"] + 256.0)), r))
        mine.sort(key=lambda x: x[0])
        sums, prefix = 0, set()
        for _, r in mine:
            if sums + r["size"] > g.need:
                break
            sums += r["size"]
            prefix.add(r.doc_id)
        extra = {r.doc_id for _, r in mine if r["_mix_copies"] > g.whole}
        closing = {r.doc_id for _, r in mine if g.closing and r.draw in g.closing}
        assert extra == prefix | closing and len(closing) <= p.CLOSINGS
        assert all(r["_mix_copies"] in (g.whole, g.whole + 1) for _, r in mine)


def test_edges(spark, edge, nothing):
    rows = p.measure(edge)
    out = p.mix(rows, p.cuts(rows, p.targets(rows)), size="size", bits="draw").collect()
    assert len(out) == len(edge_rows())
    assert all(0 <= r["_mix_copies"] <= 3 for r in out)
    sizes = {r[0]: len(words_of(r[1])) for r in edge_rows()}
    assert all(r["size"] == sizes[r.doc_id] for r in out)
    mixed = p.mixed(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r["_mix_copies"] for r in out)
    assert p.mixed(nothing).collect() == []
    blank = frame(spark, [(1, None, "a"), (2, " ", "b")])
    assert p.mixed(blank).collect() == []


def test_targets_stop_at_the_cap(spark):
    rows = local_frame(spark, [("a", 10), ("b", 1000), ("c", 5), (None, 200), ("d", 0)], "source string, size long")
    want = slow_targets({"a": 10, "b": 1000, "c": 5, None: 200, "d": 0})
    got = {r.source: r.target for r in p.targets(rows).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)
