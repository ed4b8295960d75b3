"""Packing: sum-of-squares online packing of documents into windows (operator 8).

Each task packs the documents it reads, one after the other. A level array
counts the partially filled windows of every fill level; a document goes to the
level, or to a new window, that makes the sum of squared counts least. Documents
longer than a window are cut into full windows first and their rest is placed.
At the end of a task the windows still open are merged, the fullest filled up
from the emptiest by cutting, so at most one window a task stays partly filled.
The windows left to that merge grow far slower than what a task reads (96 a task after
300 documents of the test texts, 509 after 10,000), so small partitions are put
together until a task has about `task_rows` documents; the
column `closed` tells how a window was closed: whole (a cut of one long document), rule or merge.

A task holds its open windows only, which the window size bounds. Every id,
with the end id of each document, lies in exactly one piece. Null texts are
empty and consist of the end id. Repeated rows are packed each. An empty table
gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import importable
from .tokens import encoded, encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, closed string"


class Packer:
    """Sum-of-squares packing into windows of `size`. Pieces are (document, start, length)."""

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def best(self, need: int) -> int:
        """The level to place `need` tokens at; 0 is a new window. Ties go to the fullest."""
        before = self.level[1:self.size - need + 1]
        after = self.level[1 + need:self.size + 1]
        fresh = 2 * self.level[need] + 1 if need < self.size else 0
        at = np.flatnonzero(before)
        if not len(at):
            return 0
        change = 2 * (after[at] - before[at]) + 2
        if at[-1] + 1 + need == self.size:
            change[-1] = 1 - 2 * before[-1]  # the window closes and counts no more
        pick = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(at[pick]) + 1 if change[pick] <= fresh else 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece (length below the window) somewhere; the window's pieces if that fills it."""
        need = piece[2]
        at = self.best(need)
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
        else:
            window = []
        window.append(piece)
        at += need
        if at == self.size:
            return window
        self.open.setdefault(at, []).append(window)
        self.level[at] += 1
        return None

    def finish(self) -> Iterator[list[tuple]]:
        """The open windows, the fullest filled up with cut pieces of the emptiest."""
        rest = [w for at in sorted(self.open, reverse=True) for w in self.open[at]]
        used = [at for at in sorted(self.open, reverse=True) for _ in self.open[at]]
        i, j = 0, len(rest) - 1
        while i < j:
            gap = self.size - used[i]
            doc, start, length = rest[j].pop()
            take = min(gap, length)
            rest[i].append((doc, start + length - take, take))
            used[i] += take
            used[j] -= take
            if take < length:
                rest[j].append((doc, start, length - take))
            if used[i] == self.size:
                yield rest[i]
                i += 1
            if not rest[j]:
                j -= 1
        if i == j:
            yield rest[i]


def _pack(path: str, spaces: bool, end_id: int, size: int):
    def run(batches):
        enc, packer = encoder(path, spaces), Packer(size)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        made, rows, held = 0, [], 0

        def emit(window, closed):
            nonlocal made, held
            at = 0
            for (doc_id, n, ids, first), start, length in window:
                cut = ids[4 * (start - first):4 * (start - first + length)]
                rows.append((doc_id, start, length, n, base + made, at, cut, closed))
                at += length
            made, held = made + 1, held + at

        for doc_id, ids in encoded(enc, batches):
            ids += end
            n = len(ids) // 4
            whole = n - n % size
            for start in range(0, whole, size):
                emit([((doc_id, n, ids, 0), start, size)], "whole")
            if whole < n:
                filled = packer.place(((doc_id, n, ids[4 * whole:], whole), whole, n - whole))
                if filled:
                    emit(filled, "rule")
            if held > 500_000:
                yield _rows(rows)
                rows, held = [], 0
        for window in packer.finish():
            emit(window, "merge")
        yield _rows(rows)
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 8
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary()), pa.array(cols[7], pa.string())], names)


def pack(docs: DataFrame, path: str, end_id: int, size: int = 2048, spaces: bool = True,
         task_rows: int = 10_000) -> DataFrame:
    """One row per piece with its ids as little-endian 32-bit words. One pass, no shuffle.

    The rows are counted first, so hand over a table or something cheap to
    derive. Partitions are put together, never split.
    """
    importable(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.coalesce(max(1, docs.count() // task_rows))
    return texts.mapInArrow(_pack(path, spaces, end_id, size), SCHEMA)


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)
