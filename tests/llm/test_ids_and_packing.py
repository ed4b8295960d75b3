"""Token ids against the tokenizer itself; id files and packing as exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_helpers import edge_rows, frame
from slicegauge.llm import mixing_coder as c
from slicegauge.llm import square_pack as s
from slicegauge.llm.queries import QUERIES
from slicegauge.llm.tokens import Encoder
from slicegauge.session import checkpoint_dir

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def slow_ids(path, texts, end):
    return [e.ids + [end] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,spaces", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_pieces_give_the_tokenizers_ids(spark, data, path, spaces):
    rnd = random.Random(4)
    marks = [" ", "  ", "\n", "\t \n", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "'s", "'LL", "\xe9", "e\u0301", "\u0130", "\xdf", "\u6f22", "\U0001F600",
             "12", "a", "Bc", "...", "<|endoftext|>", "<|startoftext|>", "\u03a3", "\u0391\u03a3", "\u0301", "\ufeff", "\u2028"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(0, 14))) for _ in range(4000)]
    texts += [r[1] or "" for r in edge_rows()] + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 120").collect()]
    enc = Encoder(path, spaces, remembered=500)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for at in range(0, len(texts), 37):
        for t, w, got in zip(texts[at:], want[at:], enc.ids(texts[at:at + 37])):
            assert np.frombuffer(got, "<u4").tolist() == w.ids, repr(t)


@pytest.mark.parametrize("path,spaces", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_each_new_word_is_encoded_once(path, spaces):
    enc, learnt = Encoder(path, spaces), []
    plain = enc.learn
    enc.learn = lambda new: learnt.extend(new) or plain(new)
    texts = ["x alpha beta gamma", "x alpha, beta! alpha?! gamma. alpha,", "x Élan straße, Ÿ, naïve' 12, 12 ab' 'll, a1.\nalpha\n", "x alpha, (beta) a-b, [alpha"]
    got = [enc.ids([t])[0] for t in texts * 2]
    want = Tokenizer.from_file(path).encode_batch(texts * 2, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert len(learnt) == len(set(learnt))
    assert not {p.strip() for p in learnt} & {"alpha,", "alpha?!", "beta!", "gamma."}  # marks are cut from words first
    assert enc.ids([" ".join(texts), None, ""])[1:] == [b"", b""]


def test_lanes_round_trip():
    rng = np.random.default_rng(3)
    for lanes, steps, top in ((1, 1, 65536), (1, 700, 3), (3, 1500, 65536), (40, 600, 300)):
        ids = rng.integers(0, top, (lanes, steps)).astype(np.uint16)
        ids[:, steps // 2:] = ids[:, :steps - steps // 2]
        assert (c.decode_lanes(c.encode_lanes(ids), steps) == ids).all()
    calm = np.zeros((2, 6000), np.uint16)
    calm[:, 5000:] = rng.integers(0, 65536, (2, 1000))  # after so long a calm nothing is expected any more
    assert (c.decode_lanes(c.encode_lanes(calm), 6000) == calm).all()
    same = np.full((2, 2000), 7, np.uint16)
    assert len(c.encode_lanes(same)[0]) < 200  # predictable ids cost next to nothing


def test_blocks_learn_from_each_other():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 65536, 300).astype(np.uint16)
    ids = np.array([np.roll(text, -int(rng.integers(0, 300))) for _ in range(200)])
    streams = c.encode_lanes(ids)
    assert (c.decode_lanes(streams, 300) == ids).all()
    assert sum(map(len, streams)) < 0.5 * ids.size  # no block repeats an id, so that alone each would cost two bytes an id


def test_groups_round_trip_and_damage_is_found():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (1, 0, 5000, 17, 3)]
    payload = c.pack_group([3, 4, None, 6, 7], docs, block=512, lanes=4)
    assert c.unpack_group(payload) == list(zip([3, 4, None, 6, 7], docs))
    with pytest.raises(ValueError):
        c.unpack_group(payload[:-40] + bytes(x ^ 255 for x in payload[-40:-20]) + payload[-20:])
    with pytest.raises(ValueError):
        c.pack_group([1], [np.array([70_000], "<u4").tobytes()])


def test_id_files_whole_table(spark, data):
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_mixing_coder"](spark, data).collect()}
    at = 0
    for r, ids in zip(docs, slow_ids(WORD_BPE, [r.text for r in docs], 2)):
        assert got[r.doc_id] == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(docs)


def test_id_files_edges(spark, edge, nothing):
    for i, (table, rows) in enumerate(((edge, edge_rows()), (nothing, []))):
        folder = f"{checkpoint_dir(spark)}/ids-edge-{i}"
        c.write_ids(table, WORD_BPE, folder, group_tokens=5000)
        got = sorted(c.read_ids(spark, folder).collect(), key=lambda r: r.start)
        want = defaultdict(list)
        for r, ids in zip(rows, slow_ids(WORD_BPE, [r[1] for r in rows], 2) if rows else []):
            want[r[0]].append(np.array(ids, "<u4").tobytes())
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is None, x or 0))
        at = 0
        for r in got:
            assert r.start == at and bytes(r.ids) in want[r.doc_id]
            at += len(r.ids) // 4


def check_pieces(rows, want):
    """Every id in exactly one piece, every sequence gapless and at most 2048 long; the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == crc(want[d][at:at + r.length])
            at += r.length
        assert at == len(want[d])
    full = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        full += at == 2048
    return len(by_seq) - full


def test_packing_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], slow_ids(BYTE_BPE, [r.text for r in docs], 1)))
    assert check_pieces(QUERIES["op8_square_pack"](spark, data).collect(), want) <= 8


def test_packing_edges(spark, edge, nothing):
    rows = {r[0]: r[1] for r in edge_rows() if r[0] != 9}
    some = edge.filter("doc_id <> 9 OR doc_id IS NULL").coalesce(1)
    want = dict(zip(rows, slow_ids(BYTE_BPE, rows.values(), 1)))
    assert check_pieces(s.digest(s.pack(some, BYTE_BPE, 1)).collect(), want) <= 1
    assert s.pack(nothing, BYTE_BPE, 1).collect() == []
    repeated = frame(spark, [(5, "same text here", "a")] * 9).coalesce(1)
    assert sorted(r.start for r in s.pack(repeated, BYTE_BPE, 1).collect()) == [0] * 9


def slow_windows(lengths, size):
    """The windows that one task closes by the rule, and all left open: every option tried, the sum of squares counted anew."""
    counts, windows, done = [0] * size, [], []
    for doc, n in lengths:
        start, need = n - n % size, n % size
        if not need:
            continue
        best = None
        for at in [0] + [h for h in range(1, size - need + 1) if counts[h]]:
            after = counts.copy()
            if at:
                after[at] -= 1
            if at + need < size:
                after[at + need] += 1
            option = (sum(c * c for c in after[1:]), -at, after)
            best = option if best is None or option[:2] < best[:2] else best
        at, counts = -best[1], best[2]
        window = next((w for w in reversed(windows) if sum(p[2] for p in w) == at), [])
        windows = [w for w in windows if w is not window]
        window.append((doc, start, need))
        (done if at + need == size else windows).append(window)
    return done, windows


def test_packing_in_several_tasks_follows_the_rule(spark):
    rnd, size = random.Random(3), 48
    texts = {i: " ".join(rnd.choice(("alpha", "beta", "gamma")) for _ in range(rnd.randrange(0, 70))) for i in range(900)}
    docs = frame(spark, [(i, t, "a") for i, t in texts.items()]).repartition(3, "doc_id").cache()
    parts = defaultdict(list)
    for r in docs.select("doc_id", F.spark_partition_id().alias("part")).collect():
        parts[r.part].append(r.doc_id)
    n_ids = dict(zip(texts, map(len, slow_ids(BYTE_BPE, texts.values(), 1))))
    windows = defaultdict(list)
    for r in s.pack(docs, BYTE_BPE, 1, size, task_rows=100).orderBy("sequence_id", "offset").collect():
        windows[r.closed, r.sequence_id].append((r.doc_id, r.start, r.length))
    done, left = [], 0
    for ids in parts.values():
        rule, rest = slow_windows([(i, n_ids[i]) for i in ids], size)
        done += rule
        left += sum(p[2] for w in rest for p in w)
    assert sorted(w for (how, _), w in windows.items() if how == "rule") == sorted(done)
    assert sum(p[2] for (how, _), w in windows.items() if how == "merge" for p in w) == left
    assert sum(how == "whole" for how, _ in windows) == sum(n // size for n in n_ids.values())
    docs.unpersist()


def test_small_partitions_are_put_together(spark):
    docs = frame(spark, [(i, f"text number {i}", "a") for i in range(400)]).repartition(16)
    pieces = s.pack(docs, BYTE_BPE, 1, 256, task_rows=200)
    assert pieces.select(F.shiftright("sequence_id", 40)).distinct().count() <= 2
    assert pieces.agg(F.sum("length")).first()[0] == sum(map(len, slow_ids(BYTE_BPE, [f"text number {i}" for i in range(400)], 1)))


def test_placement_minimises_the_sum_of_squares():
    rnd = random.Random(8)
    packer = s.Packer(64)
    for i in range(2000):
        need = rnd.randrange(1, 64)
        counts = packer.level[:64].copy()

        def total(at):
            n = counts.copy()
            if at:
                n[at] -= 1
            if at + need < 64:
                n[at + need] += 1
            return int((n[1:] ** 2).sum())

        options = [0] + [h for h in range(1, 65 - need) if counts[h]]
        pick = packer.best(need)
        assert total(pick) == min(map(total, options))
        packer.place((i, 0, need))
    assert packer.level[:64].sum() == sum(map(len, packer.open.values()))
