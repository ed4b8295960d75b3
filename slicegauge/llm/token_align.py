"""Alignment of two tokenizers' ids by byte ranges (operator 12).

Each text is encoded twice, as byte-level BPE ids (A) of blank + text and as
sentencepiece ids (B) of the text, to which the model adds the blank. Where the
bytes of both joined token lists are those of blank + text, tokens are aligned:
byte offsets where an A and a B token both end cut them into groups, and every
A and B token whose bytes overlap are linked.

Method: lockstep merging. The texts of a block stand side by side in one numpy
state matrix, a column each: the next A token, the next B token, the next place
in the output, the end. A step emits one link per column, a cut where both tokens
end, and moves the pointers of what ended; finished columns are compacted away.

Each text is encoded and aligned once; its distinct linked id pairs are written, packed,
to the shared folder. Counts of pairs (how many rows hold one) are added up per
task, then by Spark over all. At most `hot_pairs` of the most frequent pairs, a
fixed bound whatever the input, are broadcast to sum a text's links over them; the
rarer ones go through a shuffled join, where no key is hot any more. The highest count of
each A id is a table of at most one row per A id.

Null or empty texts, and texts that do not round-trip, have no tokens and zeros.
Repeated rows count as rows of their own and get equal results; rows without an id
are aligned too; an empty table stays empty. Strings of special tokens are plain
text. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import importable

BLOCK_BYTES = 4 << 20
HOT_PAIRS = 400_000
SHIFT = 32
# Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = re.compile(r"\S{4000}|\s{400}")


def byte_level() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bytes:
    """Ids and bytes of texts under both tokenizers.

    A's merges run in tiktoken, several times faster than in the tokenizers library,
    with the vocabulary of the given file, whose ids are in the order of its merges.
    Texts with very long runs, where its pattern search would recurse too deep, go to
    the tokenizers library. The ids are the same.
    """

    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        with open(path_a, encoding="utf-8") as f:
            given = json.load(f)
        vocab, special = given["model"]["vocab"], {t["content"] for t in given.get("added_tokens", [])}
        back = byte_level()
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(map(back.__getitem__, token))
        ranks = {self.bytes_a[i]: i for token, i in vocab.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow_a = Tokenizer.from_file(path_a)
        self.slow_a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> list[int]:
        return self.slow_a.encode(text, add_special_tokens=False).ids if LONG.search(text) else self.a.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
        """(A ids, B ids) of each text, None where there are no tokens."""
        real = [i for i, t in enumerate(texts) if t]
        out: list = [None] * len(texts)
        for i, y in zip(real, self.b.encode([texts[i] for i in real], num_threads=1)):
            text = " " + texts[i]
            raw = text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.bytes_b.__getitem__, y)) == raw:
                x = self.ids_a(text)
                if b"".join(map(self.bytes_a.__getitem__, x)) == raw:
                    out[i] = x, y
        return out


@dataclass
class Aligned:
    """Links of a block of texts, text after text; `starts_*` have one entry more than there are texts."""
    a: np.ndarray          # A ids of all texts
    b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    link_a: np.ndarray     # positions in a and b
    link_b: np.ndarray
    cut: np.ndarray        # both tokens of the link end there
    starts_link: np.ndarray


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray):
    """(link_a, link_b, cut, starts_link) of texts given by their tokens' end offsets; a text has tokens on both sides or on none."""
    room = starts_a + starts_b  # a step moves one pointer at least
    link_a, link_b = (np.full(room[-1], -1, np.int32) for _ in range(2))
    cut = np.zeros(room[-1], bool)
    state = np.stack([starts_a[:-1], starts_b[:-1], room[:-1], starts_a[1:]])
    state = state[:, state[0] < state[3]]
    while state.shape[1]:
        a, b, out, stop = state
        link_a[out], link_b[out] = a, b
        end_a, end_b = ends_a[a], ends_b[b]
        move_a, move_b = end_a <= end_b, end_b <= end_a
        cut[out] = move_a & move_b
        a += move_a
        b += move_b
        out += 1
        going = a < stop
        if not going.all():
            state = state[:, going]
    used = link_a >= 0
    before = np.concatenate([[0], np.cumsum(used)])
    return link_a[used], link_b[used], cut[used], before[room]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.bytes = Bytes(path_a, path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int32) for t in (self.bytes.bytes_a, self.bytes.bytes_b))
        self.size = max(len(self.len_a), len(self.len_b))
        self.shown = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.size)]

    def align(self, texts: list[str | None]) -> Aligned:
        sides, ends = [], []
        tokens = [x or ([], []) for x in self.bytes.encode(texts)]
        for k, length in ((0, self.len_a), (1, self.len_b)):
            starts = np.concatenate([[0], np.cumsum([len(x[k]) for x in tokens], dtype=np.int64)]).astype(np.int64)
            ids = np.concatenate([np.array(x[k], np.int32) for x in tokens]) if tokens else np.zeros(0, np.int32)
            total = np.concatenate([[0], np.cumsum(length[ids], dtype=np.int64)])
            n = np.diff(starts)
            ends.append(total[1:] - np.repeat(total[starts[:-1]], n))
            sides += [ids, starts]
        a, starts_a, b, starts_b = sides
        return Aligned(a, b, starts_a, starts_b, *lockstep(*ends, starts_a, starts_b))

    def pairs(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of each text's distinct linked id pairs; a pair is A id << 32 | B id."""
        text = np.repeat(np.arange(len(x.starts_link) - 1), np.diff(x.starts_link))
        # within a block, text, A and B id fit one key: sorted once
        key = (text * self.size + x.a[x.link_a]) * self.size + x.b[x.link_b]
        key, n = np.unique(key, return_counts=True)
        pair = key % (self.size * self.size)
        return key // (self.size * self.size), (pair // self.size << SHIFT) | pair % self.size, n

    def groups(self, x: Aligned) -> Iterator[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        last = []
        for ids, at in ((x.a, x.link_a), (x.b, x.link_b)):
            ended = np.zeros(len(ids), bool)
            ended[at[x.cut]] = True
            last.append(ended)
        end_a, end_b = (np.flatnonzero(e) + 1 for e in last)
        group_a, group_b = (np.cumsum(e) - e for e in last)
        shown = np.empty(len(x.a) + len(x.b), np.int32)
        shown[np.arange(len(x.a)) + np.concatenate([[0], end_b])[group_a]] = x.a + self.size * last[0]
        shown[np.arange(len(x.b)) + end_a[group_b]] = x.b + 2 * self.size * last[1]
        for i, j in zip(x.starts_a + x.starts_b, (x.starts_a + x.starts_b)[1:]):
            yield b"".join(map(self.shown.__getitem__, shown[i:j].tolist()))[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, so that its memory of pieces serves all its tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _blocks(batches) -> Iterator[tuple[list, list]]:
    """Ids and texts of some megabytes together; a long text may be a block alone."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            held += len(t or "")
            if held >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = (np.concatenate(x) for x in zip(*parts))
    pairs, at = np.unique(pairs, return_inverse=True)
    return pairs, np.bincount(at, n, len(pairs)).astype(np.int64)


OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _align(path_a: str, path_b: str):
    def run(batches):
        one = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for ids, texts in _blocks(batches):
            x = one.align(texts)
            text, pair, links = one.pairs(x)
            at = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
            cuts = np.concatenate([[0], np.cumsum(x.cut)])[x.starts_link]
            digest = [hashlib.sha256(g).hexdigest() if g else "" for g in one.groups(x)]
            packed = [[v[i:j].astype(kind).tobytes() for i, j in zip(at, at[1:])] for v, kind in ((pair, "<i8"), (links, "<u4"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(ids))), pa.array(ids, pa.int64()), *[pa.array(np.diff(s).astype(np.int64)) for s in (
                    x.starts_a, x.starts_b, cuts, x.starts_link)], pa.array(digest, pa.string()), *[pa.array(p, pa.binary()) for p in packed]], COLUMNS)
            row += len(ids)
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its numbers, digest and packed pairs; to be written once."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(path_a, path_b), OUT)


def _unpacked(batch, held: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row of each pair, pair, links) of some rows at a time."""
    pairs, links = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pairs", "links"))
    i = 0
    while i < len(pairs):
        j, n = i, 0
        while j < len(pairs) and (n == 0 or n + len(pairs[j]) // 8 <= held):
            n += len(pairs[j]) // 8
            j += 1
        text = np.repeat(np.arange(j - i), [len(p) // 8 for p in pairs[i:j]])
        yield i, j, text, np.frombuffer(b"".join(pairs[i:j]), "<i8"), np.frombuffer(b"".join(links[i:j]), "<u4").astype(np.int64)
        i = j


def _count(held: int = 500_000):
    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, _, pair, _ in _unpacked(batch):
                parts.append(np.unique(pair, return_counts=True))
                size += len(parts[-1][0])
                if size >= held:
                    parts = [_added(parts)]
                    size = len(parts[0][0])
                    if 2 * size >= held:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["pair", "n"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(parts)], ["pair", "n"])
    return run


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked id pairs: in how many rows, and whether no pair of its A id is in more. Written once."""
    counts = materialize(rows.select("pairs", "links").mapInArrow(_count(), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", SHIFT).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # one row per A id at most: the vocabulary bounds it
    return counts.select("pair", "n", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def hottest(counts: DataFrame, limit: int):
    """The least count that at most `limit` pairs reach, by steps of an eighth of a doubling, and those pairs in order."""
    level = F.floor(8 * F.log2("n")).cast("int").alias("level")
    per = {r.level: r.k for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("k")).collect()}  # 8 rows per doubling
    least, total = max(per, default=0) + 1, 0
    while least - 1 >= 0 and total + per.get(least - 1, 0) <= limit:
        least -= 1
        total += per.get(least, 0)
    hot = counts.filter(F.floor(8 * F.log2("n")) >= least).toPandas().sort_values("pair")
    return level, least, (hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool))


RARE = pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())]))


def _judge(hot):
    def run(batches):
        key, count, best = hot.value
        for batch in batches:
            for i, j, text, pair, links in _unpacked(batch):
                at = np.minimum(np.searchsorted(key, pair), max(0, len(key) - 1))
                known = key[at] == pair if len(key) else np.zeros(len(pair), bool)
                sums = np.zeros((2, j - i), np.int64)
                np.add.at(sums[0], text[known], links[known] * best[at[known]])
                np.add.at(sums[1], text[known], links[known] * count[at[known]])
                rare = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text[~known], np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(links[~known])], ["pair", "links"])).cast(RARE)
                kept = batch.select([c for c in COLUMNS if c not in ("pairs", "links")]).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sums[0]), pa.array(sums[1]), rare],
                                                 [*kept.schema.names, "n_best", "count_sum", "rare"])
    return run


def align(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, what its links count corpus-wide, digest of its groups."""
    spark = docs.sparkSession
    once = materialize(aligned(docs, path_a, path_b))
    counts = pair_counts(once)
    level, least, hot = hottest(counts, hot_pairs)
    rows = materialize(once.mapInArrow(_judge(spark.sparkContext.broadcast(hot)),
                                       OUT.replace("pairs binary, links binary", "n_best long, count_sum long, rare array<struct<pair:long,links:long>>")))
    rare = rows.select("row", F.inline("rare")).join(counts.filter(level < least), "pair").select(
        "row", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    rare = rare.groupBy("row").agg(F.sum("n_best").alias("rare_best"), F.sum("count_sum").alias("rare_sum"))
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def groups_of(text: str, path_a: str, path_b: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, for a look at single cases."""
    shown = next(aligner(path_a, path_b).groups(aligner(path_a, path_b).align([text]))).decode()
    return [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for g in shown.split(";")] if shown else []
