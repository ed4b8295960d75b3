"""MinHash near-dedup by one-permutation hashing (operator 4).

Each text is hashed once: its distinct shingle hashes are cut into `bins` equal
ranges and the smallest of every range is that bin's minimum; empty bins borrow
from a bin picked by a second hash until a full one is found (optimal
densification). `rows` bins make a band, a band's value a bucket. Inside a
bucket only stars are drawn, from one centre to the members, never all pairs; a node is confirmed against the likeliest
of its centres only.

Stars alone could miss a link between two members that both differ from the
centre. So the likeliest stars first merge what plainly belongs together (more
rounds with other centres may follow), and in buckets that still hold several components all members outside
the largest one are compared with the rest: blocks of them against blocks of
members, by the sketches, with pairs emitted only where the sketch estimate
allows the threshold. Every pair that comes out is confirmed on full sets.

Copies (equal sets) are one node throughout, so a group of copies never meets
itself. Components come from min-label rounds with shortcuts over written tables.

Null texts and texts without words have no set and link with nothing. Texts of
fewer words than a shingle are one shingle. A row without doc_id has no
component and is kept; it may connect others. Repeated rows share a node. Only
the id and the text are read; very long texts are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import importable, word_bytes

BROADCAST_LINKS = 100_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Sets of so few shingles are told apart exactly: their bins depend on each other, and a sketch may miss a link.
SMALL_SET = 64
# Sets up to this size also meet by shingle: two that are alike share one of the first few of each in hash order, for certain.
PREFIX_SET = 20


@dataclass(frozen=True)
class Plan:
    """A pair at 0.75 shares a band with probability 1 - (1 - 0.75^rows)^(bins/rows): all but 5e-6.

    `slack` is how far below the threshold the share of equal bins may fall for a
    pair to be confirmed: 4.4 deviations. `block` counts shingles held at once.
    """
    shingle: int = 5
    bins: int = 128
    rows: int = 4
    percent: int = 75
    rounds: int = 1
    block: int = 100_000
    slack: float = 0.17

    @property
    def bands(self) -> int:
        return self.bins // self.rows


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


WEIGHTS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-grams of a whole text; A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    used = min(k, len(h))
    n = len(h) - used + 1
    out = np.full(n, used, np.uint64)
    for i in range(used):
        out += h[i:i + n] * WEIGHTS[i]
    return np.unique(mixed(out))


def borrow_table(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin the bins to ask, one after the other, while it is empty."""
    at = np.arange(bins * tries, dtype=np.uint64)
    return (mixed(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def one_permutation(sets: list[np.ndarray], bins: int, table: np.ndarray) -> np.ndarray:
    """Densified sketches, one row per non-empty sorted set. `bins` is a power of two."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = owner * bins + (flat >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted: the first of a bin is its minimum
    sketch, full = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    sketch[cell[first]], full[cell[first]] = flat[first], True
    empty = np.flatnonzero(~full)
    for asked in table:
        if not len(empty):
            break
        lender = empty - empty % bins + asked[empty % bins]
        ok = full[lender]
        sketch[empty[ok]] = sketch[lender[ok]]
        empty = empty[~ok]
    for at in empty:  # sets of a few shingles: one more draw, among the full bins
        row = at // bins
        lenders = np.flatnonzero(full[row * bins:(row + 1) * bins])
        sketch[at] = sketch[row * bins + lenders[int(mixed(np.array([at % bins + 991], np.uint64))[0]) % len(lenders)]]
    return sketch.reshape(len(sets), bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = mixed(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, i])
    return key.view(np.int64)


def prefix_keys(s: np.ndarray, percent: int) -> list[int]:
    """Buckets of a small set's leading shingles: one more than may be missing in a set that is alike."""
    if len(s) > PREFIX_SET:
        return []
    return mixed(s[:len(s) + percent * len(s) // -100 + 1] ^ np.uint64(0x5DEECE66D)).view(np.int64).tolist()


def _sketcher(plan: Plan):
    def run(batches):
        table = borrow_table(plan.bins)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [shingle_set(t, plan.shingle) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                nodes, marks, keys = iter(()), iter(()), iter(())
                if full:
                    sketch = one_permutation(full, plan.bins, table)
                    nodes = iter([xxhash.xxh3_128_digest(s.tobytes()) for s in full])
                    marks = iter([m.tobytes() for m in mixed(sketch).astype(np.uint8)])
                    keys = iter(band_keys(sketch, plan.rows))
                pick = lambda it: [next(it) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(pick(nodes), pa.binary()),
                     pa.array(pick(marks), pa.binary()), pa.array(pick(keys), pa.list_(pa.int64())),
                     pa.array([prefix_keys(s, plan.percent) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "mark", "keys", "small"])
    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            nodes, sets = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = shingle_set(text, k).tobytes()
                if xxhash.xxh3_128_digest(raw) == node:  # not another text under the same id
                    nodes.append(node)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "hashes"])
    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    both = len(a) + len(b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (both - common)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold, as a written table."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_confirm(percent), "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of `edges` (a, b): comp is the smallest node of its component.

    Alternating star rounds: each node hangs its larger neighbours, then its
    smaller ones, below its smallest neighbour. Counting goes through partial
    aggregation, so a node with many links is one row per task.
    """
    now = materialize(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct())
    before = None
    # rounds only shorten or drop links, so one count bounds the sides of all joins
    few = now.count() <= BROADCAST_LINKS
    side, packed = (F.broadcast, lambda d: d.coalesce(8)) if few else (lambda d: d, lambda d: d)
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        big = both.join(side(low), "u").filter("v > u").selectExpr("v AS u", "least(m, u) AS v").distinct()
        big = materialize(packed(big))
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(side(least), "u").selectExpr("v AS u", "m AS v").filter("u <> v").unionByName(least.selectExpr("u", "m AS v"))
        now = materialize(packed(small.distinct()))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.selectExpr("u AS node", "v AS comp").unionByName(now.selectExpr("v AS node", "v AS comp")).distinct()


def _likely(plan: Plan):
    """Stars whose sketches allow the threshold, with the number of equal bins."""
    lowest = (plan.percent / 100 - plan.slack) * plan.bins

    def run(batches):
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, plan.bins) for i in (2, 3))
            same = (left == right).sum(axis=1)
            keep = pa.array((same >= lowest) | (b.column(4).to_numpy() < SMALL_SET), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(keep), b.column(1).filter(keep), pa.array(same.astype(np.int32)).filter(keep)], ["node", "centre", "same"])
    return run


class Block:
    """Consecutive rows of one (bucket, block, cut): members, and the outer ones to compare them with."""

    def __init__(self, plan: Plan, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks() if len(parts) > 1 else parts[0]
        col = lambda name: rows.column(name).combine_chunks() if isinstance(rows, pa.Table) else rows.column(name)
        self.rows, self.col, self.plan = rows, col, plan
        self.outer = np.flatnonzero(col("outer").to_numpy(zero_copy_only=False))
        self.rest = np.flatnonzero(~col("outer").to_numpy(zero_copy_only=False))

    def pairs(self):
        """(outer, members) row numbers whose sketches allow the threshold and whose first common band this is."""
        if not len(self.outer) or not len(self.rest):
            return
        plan, rest = self.plan, self.rest
        marks = np.frombuffer(b"".join(self.col("mark").to_pylist()), np.uint8).reshape(-1, plan.bins)
        keys = np.asarray(self.col("keys").flatten()).reshape(-1, plan.bands)
        n, comp, band = self.col("n").to_numpy(), np.array(self.col("comp").to_pylist(), object), int(self.col("band")[0].as_py())
        lowest = (plan.percent / 100 - plan.slack) * plan.bins
        for o in self.outer:
            near = ((marks[rest] == marks[o]).sum(axis=1) >= lowest) | (np.minimum(n[rest], n[o]) < SMALL_SET)
            near &= 100 * np.minimum(n[rest], n[o]) >= plan.percent * np.maximum(n[rest], n[o])
            found = rest[near]
            if len(found):  # a pair that shares bands is judged in the first of them
                first = (keys[found] == keys[o]).argmax(axis=1) == band if band < plan.bands else True
                found = found[first & (comp[found] != comp[o])]
            if len(found):
                yield int(o), found


def _blocks(plan: Plan, batches):
    """The blocks of batches sorted by (bucket, block, cut), one held at a time."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("bucket", "block", "cut")], axis=1)
        at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for i, j in zip(at, at[1:]):
            now = tuple(key[i])
            if held and now != last:
                yield Block(plan, held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield Block(plan, held)


BLOCK_SCHEMA = "bucket long, block int, cut int, outer boolean, node binary"


def _hopeful(plan: Plan):
    """The rows that have a partner to be confirmed with, so that only their sets are moved."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def run(batches):
        for block in _blocks(plan, batches):
            used = set()
            for o, found in block.pairs():
                used.add(o)
                used.update(found.tolist())
            if used:
                at = pa.array(sorted(used))
                yield pa.RecordBatch.from_arrays([block.col(c).take(at) for c in names], names)
    return run


def _linked_pairs(plan: Plan):
    """The links inside each block, confirmed on full sets."""
    def run(batches):
        for block in _blocks(plan, batches):
            a, b = [], []
            sets = node = None
            for o, found in block.pairs():
                if sets is None:
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.col("hashes")]
                    node = block.col("node").to_pylist()
                for i in found:
                    if linked(sets[o], sets[i], plan.percent):
                        a.append(min(node[o], node[i]))
                        b.append(max(node[o], node[i]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def cluster(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`."""
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(texts.mapInArrow(
        _sketcher(plan), "doc_id long, n_shingles long, node binary, mark binary, keys array<long>, small array<long>"))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("mark").alias("mark"), F.first("keys").alias("keys"),
        F.first("small").alias("small"))
    nodes = materialize(nodes)
    entries = nodes.select("node", "n", F.posexplode(F.concat("keys", "small")).alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # buckets of one node, by far the most, go no further
    entries = materialize(entries.join(shared, "bucket"))
    # sketches join the few entries left, so that stars are judged before any set is moved
    entries = materialize(entries.join(nodes.select("node", "mark", "keys"), "node"))
    wanted = entries.select("node").distinct()
    # a node's text comes from any one of its rows
    sources = rows.filter("node IS NOT NULL").join(wanted, "node", "left_semi").select("doc_id", "node")
    sources = materialize(sources.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    sets = _set_table(texts, sources, plan)
    comp = None
    edges = None
    for turn in range(plan.rounds):
        at = entries if comp is None else _with_comp(entries, comp)
        label = F.col("node") if comp is None else F.col("comp")
        at = at.withColumn("comp", label)
        if turn:
            open_ = at.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("bucket")
            at = at.join(open_, "bucket", "left_semi")
        order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "comp", "mark")
        centre = at.groupBy("bucket").agg(F.min(order).alias("c"))
        star = (at.join(centre, "bucket").filter("c.comp <> comp")
                .filter(100 * F.least("n", "c.n") >= plan.percent * F.greatest("n", "c.n"))
                .select("node", F.col("c.node").alias("centre"), "mark", F.col("c.mark").alias("other"), F.least("n", "c.n").alias("n")))
        # of all its stars a node goes with the likeliest centre; the others wait for later rounds
        star = (star.mapInArrow(_likely(plan), "node binary, centre binary, same int")
                .groupBy("node").agg(F.max(F.struct("same", "centre")).alias("x"))
                .select(F.least("node", "x.centre").alias("a"), F.greatest("node", "x.centre").alias("b")).distinct())
        found = confirmed(star, sets, plan.percent)
        if turn and found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        comp = materialize(components(edges))
    rest = _residual(entries, comp, plan)
    found = materialize(rest.join(sets, "node").repartition("bucket", "block", "cut").sortWithinPartitions("bucket", "block", "cut")
                        .mapInArrow(_linked_pairs(plan), "a binary, b binary"))
    if not found.isEmpty():
        comp = materialize(components(edges.unionByName(found)))
    named = nodes.select("node", "first_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "comp").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _set_table(texts: DataFrame, sources: DataFrame, plan: Plan) -> DataFrame:
    """(node, hashes) of every node in a bucket with others; rows of one id but several texts are told apart by their set."""
    hit = texts.join(sources.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(sources["doc_id"])).select("node", "text")
    made = hit.mapInArrow(_sets(plan.shingle), "node binary, hashes binary")
    return materialize(made.dropDuplicates(["node"]))


def _with_comp(entries: DataFrame, comp: DataFrame) -> DataFrame:
    return entries.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _residual(entries: DataFrame, comp: DataFrame, plan: Plan) -> DataFrame:
    """Rows of buckets with several components that may hold a link no star has drawn.

    In each bucket the members outside its largest component meet all others,
    cut into blocks and cuts of bounded total set size, so no task gets a whole
    bucket. A pair belongs to the first bucket it shares.
    """
    at = _with_comp(entries, comp)
    per = at.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    top = per.groupBy("bucket").agg(F.max(F.struct("k", "comp", "w")).alias("top"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("comps"))
    top = materialize(top.filter("comps > 1").select("bucket", F.col("top.comp").alias("main"), "weight", (F.col("weight") - F.col("top.w")).alias("outside")))
    at = materialize(at.join(top, "bucket"))
    blocks = F.ceil(F.col("outside") / plan.block).cast("int")
    cuts = F.ceil(F.col("weight") / (4 * plan.block)).cast("int")
    cols = ["bucket", "block", "cut", "outer", "node", "n", "comp", "band", "mark", "keys"]
    outer = (at.filter("comp <> main").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("cut", F.explode(F.sequence(F.lit(0), cuts - 1))).withColumn("outer", F.lit(True)).select(cols))
    members = (at.withColumn("cut", F.pmod(F.xxhash64("node", F.lit(1)), cuts).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("outer", F.lit(False)).select(cols))
    all_rows = outer.unionByName(members)
    keys = ["bucket", "block", "cut"]
    hopeful = materialize(all_rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_hopeful(plan), BLOCK_SCHEMA))
    facts = at.select("bucket", "node", "n", "comp", "band", "mark", "keys")
    return hopeful.join(facts, ["bucket", "node"])


def first_of_each(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: one document of each component.

    Rows without an id stay. Of rows equal in id and text one stays.
    """
    kept = materialize(cluster(docs, plan).filter("kept").select(F.col("doc_id").alias("_minhash_kept")))
    # the same plan at every size: ids are the hashed side, texts stream by
    out = docs.join(kept.distinct().hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_minhash_kept")), "left_semi")
    if kept.filter("_minhash_kept IS NOT NULL").groupBy("_minhash_kept").count().filter("count > 1").isEmpty():
        return out
    named = out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(out.filter("doc_id IS NULL"))
