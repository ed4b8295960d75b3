"""Components against all pairs by brute force."""

import random

import numpy as np

from llm_helpers import DOCS, edge_rows, frame, lower_az, words_of
from slicegauge.llm import minhash_star as m


def shingles(text):
    w = words_of(lower_az(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def truth(rows):
    """Component of each row index, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if doc_id is not None else None))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def rows_of(df):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]


def test_edges_and_columns(spark, edge):
    rows = [(r[0], r[1]) for r in edge_rows()]
    out = m.cluster(edge)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = out.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(truth(rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_chains_and_near_copies(spark):
    """A hot group of near copies that only hang together in chains, and strangers with a common passage."""
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(4000)]
    rows, text, passage = [], [rnd.choice(vocab) for _ in range(120)], [rnd.choice(vocab) for _ in range(60)]
    for i in range(120):  # drifts away: the ends of the chain share little
        rows.append((1000 + i, " ".join(text)))
        at = rnd.randrange(len(text))
        text = text[:at] + [rnd.choice(vocab)] + text[at + 1:]
    for i in range(60):
        rows.append((i, " ".join([rnd.choice(vocab) for _ in range(rnd.randrange(20, 90))] + passage)))
    rows += [(5000 + i, rows[7][1]) for i in range(50)]
    got = m.cluster(frame(spark, [(i, t, "a") for i, t in rows]))
    assert sorted(rows_of(got)) == sorted(truth(rows))


def test_sample_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 400")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(rows_of(m.cluster(docs))) == sorted(truth(rows))


def test_one_id_with_several_texts(spark):
    """Sets are told apart by their content, and repeated rows do not multiply."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a), (7, b), (7, a), (7, a), (8, a + " tail"), (9, b + " tail"), (10, "c " * 9)]
    got = sorted(rows_of(m.cluster(frame(spark, [(i, t, "a") for i, t in rows]))))
    assert got == sorted(truth(rows))


def test_empty_table(nothing):
    assert m.cluster(nothing).collect() == []
    assert m.first_of_each(nothing).columns == nothing.columns


def test_stage_keeps_one_of_each(spark, edge):
    kept = m.first_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 2, 3, 4, 5, 6, 10, 11, 12] and ids.count(None) == 1


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    plan, table = m.Plan(), m.borrow_table(128)
    for size in (20, 200, 2000):
        same = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, size * 5 // 4, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(pool[:size]), np.sort(pool[len(pool) - size:])
            s = m.one_permutation([a, b], plan.bins, table)
            same.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(same)) < 0.06


def test_confirm_uses_the_exact_border():
    a = np.arange(100, dtype=np.uint64)
    assert m.linked(a, np.arange(25, 100, dtype=np.uint64), 75) and not m.linked(a, np.arange(26, 100, dtype=np.uint64), 75)


def test_no_link_between_short_texts_is_lost(spark):
    """7 against 8 words: 3 of 4 shingles, exactly at the threshold, where bins depend on each other."""
    pairs = [" ".join(f"a{i}w{j}" for j in range(7)) for i in range(2_000)]
    rows = [(2 * i, x, "s") for i, x in enumerate(pairs)] + [(2 * i + 1, x + " more", "s") for i, x in enumerate(pairs)]
    out = {r.doc_id: r.component_id for r in m.cluster(frame(spark, rows)).collect()}
    assert sum(out[2 * i + 1] != 2 * i for i in range(len(pairs))) == 0
