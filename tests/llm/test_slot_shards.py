"""Placement, balance, and edits of the slot map."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from llm_helpers import edge_rows
from slicegauge.llm import slot_shards as s
from slicegauge.llm.queries import QUERIES
from slicegauge.session import checkpoint_dir


def test_whole_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op2_slot_shards"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    used, at = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        used[r.shard] += r.size
        at[r.shard].append(r.slot)
    assert set(used) == set(range(40)) and max(used.values()) - min(used.values()) < 0.02 * min(used.values())
    assert all(sorted(x) == list(range(len(x))) for x in at.values())


def test_edges(spark, edge, nothing):
    rows = s.records(edge)
    sums = s.slot_sums(rows)
    assert sum(n for _, n in sums) == len(edge_rows())
    path = f"{checkpoint_dir(spark)}/edge-map"
    s.write_map(spark, path, 0, s.first_map(sums, 3), sums)
    out = s.place(rows, s.read_map(spark, path)).collect()
    for k, slots in Counter(r.shard for r in out).items():
        assert sorted(r.slot for r in out if r.shard == k) == list(range(slots))
    with pytest.raises(Exception, match="(?i)exist"):
        s.write_map(spark, path, 0, s.first_map(sums, 3), sums)
    none = s.records(nothing)
    empty = f"{checkpoint_dir(spark)}/empty-map"
    s.write_map(spark, empty, 0, s.first_map(s.slot_sums(none), 3), s.slot_sums(none))
    assert s.place(none, s.read_map(spark, empty)).collect() == []


def test_edits_move_few_slots_and_keep_old_versions(spark):
    rnd = random.Random(1)
    sums = [(rnd.randrange(1, 2000), 1) for _ in range(2048)]
    owner = s.first_map(sums, 20)
    load = Counter()
    for k, (b, _) in zip(owner, sums):
        load[k] += b
    mean = sum(load.values()) / 20
    assert max(load.values()) < 1.01 * mean
    assert s.rebalanced(owner, sums, 20) == owner
    grown = s.rebalanced(owner, sums, 21)
    assert all(b == 20 for a, b in zip(owner, grown) if a != b)
    assert abs(sum(b for k, (b, _) in zip(grown, sums) if k == 20) * 21 - mean * 20) < 0.05 * mean * 20
    shifted = [(b * 3 if k == 4 else b, n) for k, (b, n) in zip(owner, sums)]
    moved = s.rebalanced(owner, shifted, 20)
    after = Counter()
    for k, (b, _) in zip(moved, shifted):
        after[k] += b
    mean = sum(after.values()) / 20
    assert max(after.values()) <= 1.02 * mean and min(after.values()) >= 0.98 * mean
    from_others = sum(a != b and a != 4 for a, b in zip(owner, moved))
    assert from_others <= 0.01 * len(owner) and sum(a != b for a, b in zip(owner, moved)) < 0.1 * len(owner)
    path = f"{checkpoint_dir(spark)}/versions"
    s.write_map(spark, path, 0, owner, sums)
    s.write_map(spark, path, 1, grown, sums)
    assert s.read_map(spark, path).agg({"shard": "max"}).first()[0] == 20
    assert s.read_map(spark, path, 0).agg({"shard": "max"}).first()[0] == 19
