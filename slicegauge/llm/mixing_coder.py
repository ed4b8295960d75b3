"""Token-id output by an adaptive context-mixing range coder (operator 3).

Ids are coded in blocks, each with its own stream and checksum. Per id three
predictors look at the ids before it: order 2 and order 1 each remember the id
that last followed their context and how often it held, order 0 counts ids.
Three adaptive distributions over the outcomes (order 2 is right, order 1 is
right, the id is among order 0's, it is new) are mixed by weights that follow
their success; the mixture and then order 0's frequencies drive a 64-bit range
coder.

The blocks of a group run side by side as lanes of numpy arrays, so a step codes
one id of every block. All lanes share one model, which starts empty and learns
after every few steps: until then the mixture of each of its 2048 states is
fixed, so an id costs a look into tables. A group, not a block, can be read
alone. Only integers are used, which give the same bits wherever the file is read.

Documents are dealt into ranges of ascending id and a task writes its range as a
Parquet table with one row per group of whole documents: payload, and a plain
index of its documents. The writer commits per task, so lost executors repeat
their range only.

Null texts are empty: they consist of the end id. Rows without an id come last;
of rows with equal ids the order is that of a hash of the text. An empty table
gives an empty table of groups. Only the id and the text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import importable, ranked, shuffle_parts
from .tokens import encoded, encoder

MAGIC = b"CMR2"
BLOCK = 1024
LANES = 2048
STATES = 2048
# Words remembered beside the lanes' arrays: less than where tokens are all a worker holds.
REMEMBERED = 800_000
EMPTY = np.int64(1 << 23)
LEARNT = 4
MIX = 14
MIX_BITS, ID_BITS, WORD_BITS, WORD = np.uint64(MIX), np.uint64(16), np.uint64(32), np.uint64(1 << 32)
GROUP_SCHEMA = "part int, seq int, n_docs int, n_tokens long, payload binary"


class Model:
    """Predictors and mixture that all lanes share. Encoder and decoder take the same steps, in integers only.

    A slot of orders 1 and 2 holds the id that followed, shifted by seven bits,
    and how often it held (0 to 7) where the state has it. The state of an id
    is the last two outcomes of its lane, both slots' counts and whether they agree.
    """

    def __init__(self):
        self.one, self.two = np.full(1 << 16, EMPTY), np.full(1 << 18, EMPTY)
        state = np.arange(STATES)
        self.past, count1, count2, agree = state >> 7, state >> 4 & 7, state >> 1 & 7, state & 1
        self.views = [self.past, count1 | ((count2 > 0) << 3), count2 | (agree << 3)]
        self.members = [(v == np.arange(16)[:, None]).astype(np.int64) for v in self.views]
        self.seen = [np.tile(np.array([4, 2, 5, 5]), (16, 1)) for _ in range(3)]
        self.success = np.full((16, 3), 256)
        self.count = np.zeros(1 << 16, np.int64)
        self.refresh()
        self.mix()

    def refresh(self) -> None:
        """Take order 0's counts over into its coding table: start and frequency, out of 2^16, of every id; for new ones the id and 1."""
        n = self.count
        total, kinds = max(int(n.sum()), 1), int(np.count_nonzero(n))
        freq = np.where(n > 0, 1 + n * ((1 << 16) - kinds) // total, 0)
        if kinds:
            freq[n.argmax()] += (1 << 16) - freq.sum()
        known = freq > 0
        self.outcome0 = 3 - known
        self.freq0 = np.where(known, freq, 1).astype(np.uint64)
        self.start0 = np.where(known, np.cumsum(freq) - freq, np.arange(1 << 16)).astype(np.uint64)
        self.lookup = np.repeat(np.arange(1 << 16), freq) if kinds else np.zeros(1 << 16, np.int64)

    def mix(self) -> None:
        """Start and frequency, out of 2^MIX, of the four outcomes in every state."""
        share = 1024 + self.success * (65536 - 3 * 1024) // self.success.sum(axis=1, keepdims=True)
        self.parts = []
        for m, view in enumerate(self.views):
            q = self.seen[m] * 65536 // self.seen[m].sum(axis=1, keepdims=True)
            self.parts.append(q[view] * share[self.past, m][:, None])
        self.mixed = self.parts[0] + self.parts[1] + self.parts[2]
        freq = 1 + (self.mixed >> 16) * ((1 << MIX) - 4) // 65536
        freq[:, 3] = (1 << MIX) - freq[:, :3].sum(axis=1)
        start = np.cumsum(freq, axis=1) - freq
        self.freq, self.start = freq.ravel().astype(np.uint64), start.ravel().astype(np.uint64)
        self.bounds = [start[:, i].astype(np.uint64) for i in (1, 2, 3)]

    def slot(self, prev: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        return (prev2 * 60493 ^ prev << 2) & (1 << 18) - 1

    def look(self, x: np.ndarray, prev: np.ndarray, prev2: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of some steps of all lanes: outcomes, state and outcome as one number, and what `learn` needs. past: the two outcomes before."""
        at2 = self.slot(prev, prev2)
        e1, e2 = self.one.take(prev), self.two.take(at2)
        hit1, hit2 = e1 >> 7 == x, e2 >> 7 == x
        k = self.outcome0.take(x)
        np.copyto(k, 1, where=hit1)
        np.copyto(k, 0, where=hit2)
        rows = np.concatenate([past, k])
        mark = rows[:-2] << 11
        mark |= rows[1:-1] << 9
        mark |= (e1 & 0x70 | e2 & 0xE) << 2
        mark += (e1 ^ e2 < 128) * 4
        mark |= k
        return k, mark, ((self.one, prev, e1, hit1, 4), (self.two, at2, e2, hit2, 1))

    def learn(self, x: np.ndarray, mark: np.ndarray, slots: tuple) -> None:
        """Take over some steps of all lanes; where lanes meet in a slot, the last step and lane counts."""
        for table, at, e, hit, shift in slots:
            held = e >> shift & 7
            change = np.where(hit, held < 7, (held >> 1) - held)
            table[at] = np.where(hit | (held > 2), e + (change << shift), x << 7 | 1 << shift)
        n = np.bincount(mark.ravel(), minlength=4 * STATES).reshape(-1, 4)
        for m, part in enumerate(self.parts):
            self.success[:, m] += ((part << 8) // (self.mixed + 1) * n).reshape(16, -1).sum(axis=1)
            self.seen[m] += self.members[m] @ n
            self.seen[m] = np.where(self.seen[m].sum(axis=1, keepdims=True) > 1 << 16, self.seen[m] + 1 >> 1, self.seen[m])
        self.success = np.where(self.success.sum(axis=1, keepdims=True) > 1 << 24, self.success + 1 >> 1, self.success)
        self.mix()
        self.count += np.bincount(x.ravel(), minlength=1 << 16)


def spans(steps: int) -> Iterator[tuple[int, int, bool, bool]]:
    """Runs of steps: 1, 1, 2, 4, 8, then 16 each. The model learns after all of the first 128 steps
    and one run in LEARNT from then on; order 0's coding table follows by then and every 128 steps."""
    at, size = 0, 1
    while at < steps:
        to = min(at + size, steps)
        yield at, to, to <= 128 or at // size % LEARNT == 0, to <= 128 or to % 128 == 0
        at += size
        size = min(at, 16)


class Sink:
    """Range encoders side by side; each step writes at most one 32-bit word a lane."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64((1 << 64) - 1))
        self.out, self.used = np.zeros((lanes, most), np.uint32), np.zeros(lanes, np.int64)

    def put(self, start: np.ndarray, freq: np.ndarray, late: np.ndarray, start0: np.ndarray, freq0: np.ndarray) -> None:
        """Outcomes of all lanes, and order 0's ids of those in `late`."""
        r = self.range >> MIX_BITS
        self.low += start * r
        r *= freq
        part = r[late] >> ID_BITS
        self.low[late] += start0 * part
        r[late] = freq0 * part
        self.range = r
        small = np.flatnonzero(r < WORD)
        if len(small):
            low, used = self.low[small], self.used[small]
            self.out[small, used] = low >> WORD_BITS
            self.used[small] = used + 1
            self.low[small], self.range[small] = shifted(low, r[small])

    def finish(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for part in (self.low >> WORD_BITS, self.low & (WORD - np.uint64(1))):
            self.out[lane, self.used] = part
            self.used += 1
        return [self.out[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.used)]


def shifted(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word out: a range that straddles a word border is cut at it first, so no carry is ever owed."""
    over = low ^ (low + width) >= WORD
    if over.any():
        width = np.where(over, (~low + np.uint64(1)) & (WORD - np.uint64(1)), width)
    return low << WORD_BITS, width << WORD_BITS


class Source:
    """The decoders' side of Sink."""

    def __init__(self, streams: list[bytes]):
        words = [np.frombuffer(s, "<u4") for s in streams]
        self.words = np.zeros((len(words), max(map(len, words)) + 2), np.uint64)
        for i, x in enumerate(words):
            self.words[i, :len(x)] = x
        self.low, self.range = np.zeros(len(words), np.uint64), np.full(len(words), np.uint64((1 << 64) - 1))
        self.gap = self.words[:, 0] << WORD_BITS | self.words[:, 1]
        self.used = np.full(len(words), 2)

    def outcome(self) -> np.ndarray:
        """Where every lane's outcome lies, out of 2^MIX."""
        self.r = self.range >> MIX_BITS
        return np.minimum(self.gap // self.r, np.uint64((1 << MIX) - 1))

    def take_outcome(self, start: np.ndarray, freq: np.ndarray) -> None:
        start *= self.r
        self.low += start
        self.gap -= start
        self.range = self.r * freq

    def id(self, late: np.ndarray) -> np.ndarray:
        """Where the ids of the lanes in `late` lie in order 0's table."""
        self.late, self.part, self.rest = late, self.range[late] >> ID_BITS, self.gap[late]
        return np.minimum(self.rest // self.part, np.uint64(65535)).view(np.int64)

    def take_id(self, start: np.ndarray, freq: np.ndarray) -> None:
        step = start * self.part
        self.low[self.late] += step
        self.gap[self.late] = self.rest - step
        self.range[self.late] = self.part * freq

    def refill(self) -> None:
        small = np.flatnonzero(self.range < WORD)
        if len(small):
            used = self.used[small]
            self.gap[small] = self.gap[small] << WORD_BITS | self.words[small, np.minimum(used, self.words.shape[1] - 1)]
            self.used[small] = used + 1
            self.low[small], self.range[small] = shifted(self.low[small], self.range[small])


def encode_lanes(ids: np.ndarray) -> list[bytes]:
    """ids[lane, step] (below 2^16) as one stream a lane."""
    lanes, steps = ids.shape
    model, sink = Model(), Sink(lanes, steps + 4)
    rows = np.zeros((steps + 2, lanes), np.int64)  # two rows of zeros stand before the first step
    rows[2:] = ids.T
    past = np.zeros((2, lanes), np.int64)
    for a, b, learn, refresh in spans(steps):
        x = rows[a + 2:b + 2]
        k, mark, slots = model.look(x, rows[a + 1:b + 1], rows[a:b], past)
        start, freq = model.start.take(mark), model.freq.take(mark)
        for t in range(b - a):
            late = np.flatnonzero(k[t] >= 2)
            found = x[t].take(late)
            sink.put(start[t], freq[t], late, model.start0.take(found), model.freq0.take(found))
        past = np.concatenate([past, k])[-2:]
        if learn:
            model.learn(x, mark, slots)
        if refresh:
            model.refresh()
    return sink.finish()


def decode_lanes(streams: list[bytes], steps: int) -> np.ndarray:
    lanes = len(streams)
    model, source = Model(), Source(streams)
    rows = np.zeros((steps + 2, lanes), np.int64)
    past = np.zeros((2, lanes), np.int64)
    for a, b, learn, refresh in spans(steps):
        one, two, start, freq, (c1, c2, c3) = model.one, model.two, model.start, model.freq, model.bounds
        outcomes = [*past]
        for t in range(a, b):
            e1, e2 = one.take(rows[t + 1]), two.take(model.slot(rows[t + 1], rows[t]))
            state = outcomes[-2] << 9
            state |= outcomes[-1] << 7
            state |= e1 & 0x70
            state |= e2 & 0xE
            state += e1 ^ e2 < 128
            at = source.outcome()
            k8 = (at >= c1.take(state)).view(np.int8) + (at >= c2.take(state)).view(np.int8) + (at >= c3.take(state)).view(np.int8)
            k = k8.astype(np.int64)
            state <<= 2
            state |= k
            source.take_outcome(start.take(state), freq.take(state))
            x = np.where(k8 == 1, e1, e2) >> 7
            x &= 0xFFFF  # in a damaged stream a slot may be empty
            late = np.flatnonzero(k8 >= 2)
            if len(late):
                at = source.id(late)
                found = np.where(k8.take(late) == 2, model.lookup.take(at), at)
                source.take_id(model.start0.take(found), model.freq0.take(found))
                x[late] = found
            source.refill()
            rows[t + 2] = x
            outcomes.append(k)
        x = rows[a + 2:b + 2]
        if learn:
            _, mark, slots = model.look(x, rows[a + 1:b + 1], rows[a:b], past)
            model.learn(x, mark, slots)
        past = np.array(outcomes[-2:])
        if refresh:
            model.refresh()
    return np.ascontiguousarray(rows[2:].T)


def pack_group(doc_ids: list[int | None], docs: list[bytes], block: int = BLOCK, lanes: int = LANES) -> bytes:
    """Documents (ids as little-endian 32-bit words) as one self-contained payload."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids of this format are below 65536")
    blocks = [ids[i:i + block] for i in range(0, len(ids), block)]
    streams: list[bytes] = []
    for at in range(0, len(blocks), lanes):
        part = blocks[at:at + lanes]
        table = np.zeros((len(part), max(map(len, part))), np.uint16)
        for i, b in enumerate(part):
            table[i, :len(b)] = b
        streams += encode_lanes(table)
    head = struct.pack("<4sIIII", MAGIC, len(docs), len(blocks), block, lanes)
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array([len(d) // 4 for d in docs], "<u4").tobytes()
    sizes = b"".join(struct.pack("<III", len(b), len(s), zlib.crc32(b.astype("<u4").tobytes())) for b, s in zip(blocks, streams))
    return head + index + sizes + b"".join(streams)


def unpack_group(payload: bytes) -> list[tuple[int | None, bytes]]:
    """(doc_id, ids) of every document; raises if a block fails its checksum."""
    magic, n, n_blocks, _, lanes = struct.unpack_from("<4sIIII", payload)
    if magic != MAGIC:
        raise ValueError("not a group of this format")
    at = 20
    doc_ids = np.frombuffer(payload, "<i8", n, at)
    missing = payload[at + 8 * n:at + 9 * n]
    counts = np.frombuffer(payload[at + 9 * n:at + 13 * n], "<u4")
    at += 13 * n
    heads = [struct.unpack_from("<III", payload, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    parts = []
    for first in range(0, n_blocks, lanes):
        group, streams = heads[first:first + lanes], []
        for _, size, _ in group:
            streams.append(payload[at:at + size])
            at += size
        table = decode_lanes(streams, max(h[0] for h in group))
        for row, (size, _, crc) in zip(table, group):
            raw = row[:size].astype("<u4").tobytes()
            if zlib.crc32(raw) != crc:
                raise ValueError("block fails its checksum")
            parts.append(raw)
    ids, out, pos = b"".join(parts), [], 0
    for d, gone, c in zip(doc_ids.tolist(), missing, counts.tolist()):
        out.append((None if gone else d, ids[pos:pos + 4 * c]))
        pos += 4 * c
    return out


def _writer(path: str, end_id: int, group_tokens: int):
    def run(batches):
        enc, end, part = encoder(path, False, REMEMBERED), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        doc_ids, docs, held, seq = [], [], 0, 0

        def group():
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int32()),
                pa.array([held], pa.int64()), pa.array([pack_group(doc_ids, docs)], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for doc_id, ids in encoded(enc, batches):
            ids += end
            doc_ids.append(doc_id), docs.append(ids)
            held += len(ids) // 4
            if held >= group_tokens:
                yield group()
                doc_ids, docs, held, seq = [], [], 0, seq + 1
        if docs:
            yield group()
    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, group_tokens: int = BLOCK * LANES) -> None:
    """Encode whole texts and write them as groups in ascending order of doc_id."""
    importable(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_writer(tokenizer, end_id, group_tokens), GROUP_SCHEMA).write.parquet(folder)


def _reader(batches):
    for b in batches:
        for part, seq, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
            docs = unpack_group(payload)
            ids = [d[1] for d in docs]
            before = np.cumsum([0] + [len(x) // 4 for x in ids])[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(docs), pa.int32()), pa.array([seq] * len(docs), pa.int32()), pa.array([d[0] for d in docs], pa.int64()),
                pa.array(before, pa.int64()), pa.array(ids, pa.binary())], ["part", "seq", "doc_id", "before", "ids"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole collection) and ids of every document in the files."""
    importable(spark)
    groups = spark.read.schema(GROUP_SCHEMA).parquet(folder)
    starts = ranked(groups.select("part", "seq", "n_tokens"), [F.col("part"), F.col("seq")], "_at", {"first": "n_tokens"})
    docs = groups.select("part", "seq", "payload").mapInArrow(_reader, "part int, seq int, doc_id long, before long, ids binary")
    return docs.join(starts.select("part", "seq", "first"), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "ids")


def new_folder(base: str) -> str:
    return f"{base}/ids-{uuid.uuid4().hex}"
