"""Phrase collocations by SON partitioning (operator 11).

Texts are cut at punctuation and line ends into pieces, pieces at blanks into
words; A-Z are lowered. A phrase is a run of 1 to `longest` words of a piece,
and everything is counted per language (null: `und`).

Two passes over the texts (Savasere, Omiecinski, Navathe). In the first, every
task mines its own texts completely, level by level, for phrases above the
support scaled down by the task's share of the language's bytes (and never above
`local` a shard). Tasks tell by how much a phrase exceeds that. The shares add up to less
than the support, so a phrase that reaches the support everywhere is told by one
task at least; and it is in the union only if what was told and all that may be
untold reach the support together. The union travels as a bit set; a collision of
hashes only adds a candidate. The second pass counts every phrase in the union, in
all shards, exactly, and only counts that reach the support stay.

Bounds: a task reads its texts in shards of at most one and a half times `shard_words`
words and a text, held as numpy ids, whatever the size of the task. The shards of a
task of the first pass wait in files between the levels, and the counts of a level meet in
a table of a byte a place (at most 128 MB): a phrase that stays below the bound there is
in no shard of the next level. So the first pass has as many tasks as may leave
`local` untold, larger ones in a larger corpus, and tells no more of a word as it
grows. The bit set is 2 to 16 MB; a task of the second pass holds at most some 400,000
counts more than one shard finds, and tells a hot phrase once. Small input partitions
are first joined, without a shuffle, into tasks of `shard_bytes`.
With a support under 25 the tasks that may leave `local` untold are too few: all tasks
then tell more, at worst every phrase (as hash and count), and the union is exact.

Null, empty or blank texts have no words; repeated rows count as often as they
occur; ties go by phrase in byte order; an empty table gives no rows. Columns
other than the text and the language are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .base import importable

# Cuts become a lone '.', which is in no word as it is a cut itself; tabs become blanks.
CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"." * 10 + b" ")
SLOT_BITS = 24
MOST_BITS = 27
SHARD_WORDS = 5_000_000
SHARD_BYTES = 64 << 20
LOCAL = 2
SALTS = 4
# Positions that are sorted at once.
BLOCK = 1_000_000
# Places of a task's tally (a power of two), and the highest count that a task may leave untold.
TALLY_BITS = 27
MOST_LOCAL = 7
# With fewer tasks to tell, every phrase is told by as many as there are.
FEW = 8


def lang_column() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def slots_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a phrase in a set of 2**bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def in_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = slots_of(h, len(bits).bit_length() + 5)
    one = np.uint64(1)
    hit = [(bits[s >> 6] >> (s & 63).astype(np.uint64)) & one for s in (a, b)]
    return (hit[0] & hit[1]).astype(bool)


class Shard:
    """Words of some texts as dense ids per (language, word); id 0 stands between pieces."""

    def __init__(self):
        self.next = count(1).__next__
        self.ids: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.bytes: dict[str, int] = defaultdict(int)
        self.n_words: dict[str, int] = defaultdict(int)

    def add(self, text: str | None, lang: str) -> None:
        if lang not in self.ids:
            self.ids[lang] = defaultdict(self.next, {b".": 0})
        if not text:
            return
        raw = text.encode("utf-8", "surrogatepass")
        self.bytes[lang] += len(raw)
        words = raw.lower().translate(CUTS).replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(np.fromiter(map(self.ids[lang].__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.n_words[lang] += len(words) - words.count(b".")

    def words(self) -> tuple[list[bytes], np.ndarray, list[str]]:
        """Per id: the word, its language's number; and the languages. Nothing can be added afterwards."""
        langs = list(self.ids)
        n = 1 + sum(len(d) - 1 for d in self.ids.values())
        word, lang = [b""] * n, np.zeros(n, np.int32)
        for k, name in enumerate(langs):
            for w, i in self.ids[name].items():
                if i:
                    word[i], lang[i] = w, k
            self.ids[name].clear()
        return word, lang, langs

    def levels(self, word: list[bytes], lang: np.ndarray, langs: list[str], longest: int, keep) -> Iterator[tuple]:
        """(first position, counts, hash, language) of the kept phrases, level by level.

        `keep(counts, hash, language)` says which phrases of a level stay; the
        next level is built only from neighbours that both stayed.
        """
        w, own, n = self.start(word, lang, langs)
        stay = keep(n, own, lang) & (n > 0)
        stay[0] = False
        first = np.zeros(len(word), np.int32)
        first[w[::-1]] = np.arange(len(w) - 1, -1, -1, dtype=np.int32)
        yield w, first[stay], n[stay], lang[stay]
        # `at`: where a kept phrase of the level starts; `ids`: its number; `h`, `lang_of`: by number
        at = np.flatnonzero(stay[w]).astype(np.int32)
        ids, h, lang_of = w[at], own, lang
        del n, first
        for size in range(2, longest + 1):
            at, ids, first, n, h, lang_of = grown(w, own, at, ids, h, lang_of, size, keep)
            if at is None:
                return
            yield w, first, n, lang_of
            at, ids = at[ids >= 0], ids[ids >= 0]

    def start(self, word: list[bytes], lang: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in a row; by id, the word's hash and count."""
        w = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        self.parts = []
        own = np.array([0] + [xxhash.xxh64_intdigest(x, lang_seed(langs[k])) for x, k in zip(word[1:], lang[1:].tolist())], np.uint64)
        return w, own, np.bincount(w, minlength=len(word))


def grown(w: np.ndarray, own: np.ndarray, at: np.ndarray, ids: np.ndarray, h: np.ndarray, lang_of: np.ndarray, size: int, keep=None) -> tuple:
    """Phrases one word longer than those that stayed: where neighbours both stayed, their numbers (-1: not kept); by number
    the first position, count, hash and language. Without such neighbours all are None."""
    pair = np.flatnonzero(at[1:] == at[:-1] + 1)  # its neighbour one word on stayed too
    if not len(pair):
        return (None,) * 6
    before, here = ids[pair], at[pair]
    ids, found = np.full(len(here), -1, np.int32), []
    blocks, known = -(-len(here) // BLOCK), 0
    for b in range(blocks):  # by the phrase one word shorter, so that equal phrases meet
        rows = np.flatnonzero(before % blocks == b).astype(np.int32)
        uniq, first, same, n = numbered(before[rows].astype(np.int64) * len(own) + w[here[rows] + (size - 1)])
        head, last = uniq // len(own), uniq % len(own)
        with np.errstate(over="ignore"):
            code = mixed(h[head] * np.uint64(0x9E3779B97F4A7C15) + own[last])
        stay = np.ones(len(n), bool) if keep is None else keep(n, code, lang_of[head])
        number = np.where(stay, np.cumsum(stay) - 1 + known, -1).astype(np.int32)
        ids[rows] = number[same]
        known += int(stay.sum())
        found.append((here[rows[first[stay]]], n[stay], code[stay], lang_of[head[stay]]))
    first, n, h, lang_of = (np.concatenate(x) for x in zip(*found))
    return here, ids, first, n, h, lang_of


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each comes first, every key's number, counts: np.unique in half the memory."""
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    ids = np.empty(len(key), np.int32)
    ids[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[start], order[start], ids, np.diff(start, append=len(key))


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _shards(batches, shard_words: int) -> Iterator[Shard]:
    """Shards of `shard_words` words, or half as many more: a task's rest is never a tiny shard, whose local support would be 1."""
    shard, waiting, more = Shard(), [], 0
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if shard.size < shard_words:
                shard.add(text, lang)
                continue
            waiting.append((text, lang))
            more += len(text.split()) if text else 0
            if 2 * more >= shard_words:
                yield shard
                shard = Shard()
                for pair in waiting:
                    shard.add(*pair)
                waiting, more = [], 0
    for pair in waiting:
        shard.add(*pair)
    if shard.ids:
        yield shard


class Tally:
    """Counts of hashes over the shards of a task in one byte a place, up to a bound. Equal places only raise a count."""

    def __init__(self, words: int, most: int):
        self.bits, self.most = min(TALLY_BITS, max(16, int(words).bit_length())), most
        self.table = np.zeros(1 << self.bits, np.uint8)

    def at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        """Hashes that differ, so few of a call share a place."""
        at = self.at(h)
        np.add.at(self.table, at, np.minimum(n, self.most).astype(np.uint8))
        self.table[at] = np.minimum(self.table[at], self.most)


class Shelf:
    """What a task knows of its shards: in memory while there is one, else in files that go with the task."""

    def __init__(self):
        self.one: dict[str, dict] = {}
        self.folder, self.n = None, 0

    def put(self, i: int, kind: str, **arrays: np.ndarray) -> None:
        self.n = max(self.n, i + 1)
        if self.n == 1:
            self.one[kind] = arrays
            return
        if self.folder is None:
            spill = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
            self.folder = tempfile.TemporaryDirectory(dir=spill[os.getpid() % len(spill)] if spill else None)
            one, self.one = self.one, {}
            for k, v in one.items():
                self.put(0, k, **v)
        for name, v in arrays.items():
            np.save(f"{self.folder.name}/{i}-{kind}-{name}.npy", v)

    def get(self, i: int, kind: str, *names: str, mapped: bool = False) -> list[np.ndarray]:
        if self.folder is None:
            return [self.one[kind][name] for name in names]
        return [np.load(f"{self.folder.name}/{i}-{kind}-{name}.npy", mmap_mode="r" if mapped else None) for name in names]

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _met(shelf: Shelf, shards: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, hashes and counts over the shards of what they tell in a range of the hash."""
    told = []
    for i in shards:
        k, h, n = shelf.get(i, "told", "k", "h", "n", mapped=True)
        part = slice(np.searchsorted(h, np.uint64(low)), np.searchsorted(h, np.uint64(high), "right"))
        told.append((k[part], h[part], n[part].astype(np.int64)))
    k, h, n = (np.concatenate(x) for x in zip(*told))
    order = np.lexsort((k, h))
    k, h = k[order], h[order]
    start = np.flatnonzero(np.append(len(h) > 0, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))[:len(h)])
    return k[start], h[start], np.add.reduceat(n[order], start) if len(h) else n


def _mine(totals, support: int, longest: int, shard_words: int, local: int):
    """First pass: (lang, hash, excess) of every locally frequent phrase, and per language what a task has not told (no hash).

    The shards of a task tell together: level by level, a phrase stays in all of
    them or in none, by its count in the whole task.
    """
    def rows(names, k, h, n):
        code = pa.nulls(len(k), pa.int64()) if h is None else pa.array(h.view(np.int64))
        return pa.RecordBatch.from_arrays([names.take(pa.array(k)), code, pa.array(n.astype(np.int64))], ["lang", "hash", "excess"])

    def run(batches):
        shelf, langs, size, words = Shelf(), {}, defaultdict(int), 0
        try:
            for i, shard in enumerate(_shards(batches, shard_words)):
                word, lang, names = shard.words()
                lang = np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)[lang]
                for x, m in shard.bytes.items():
                    size[x] += m
                w, own, n = shard.start(word, lang, list(langs))
                words += len(w)
                n[0] = 0
                there = n > 0
                ids = (np.cumsum(there) - 1).astype(np.int32)[w]
                ids[w == 0] = -1
                shelf.put(i, "text", w=w, own=own)
                shelf.put(i, "level", at=np.arange(len(w), dtype=np.int32), ids=ids, n=n[there].astype(np.int32), h=own[there], lang=lang[there])
                del shard, word, w, own, n, ids
            names = pa.array(list(langs), pa.string())
            # counts up to this stay untold; all tasks together leave less than `support` untold
            share = np.array([(support - 1) * size[x] / max(1, totals.value[x]) for x in langs])
            # a task of several shards may leave more, while all tasks together would leave two thirds of the support
            untold = np.minimum(np.minimum(np.maximum(local, 2 * share / 3), min(MOST_LOCAL, local * shelf.n)), share).astype(np.int64)
            if langs:
                yield rows(names, np.arange(len(langs)), None, untold)
            open_ = list(range(shelf.n))
            for length in range(1, longest + 1):
                tally = Tally(words, int(untold.max(initial=0)) + 1) if shelf.n > 1 else None
                for i in open_ if tally else []:
                    tally.add(*shelf.get(i, "level", "h", "n"))
                told, left = 0, []
                for i in open_:
                    at, ids, n, h, lang = shelf.get(i, "level", "at", "ids", "n", "h", "lang")
                    stay = (n if tally is None else tally.table[tally.at(h)]) > untold[lang]
                    order = np.flatnonzero(stay)[np.argsort(h[stay])]
                    told += len(order)
                    shelf.put(i, "told", k=lang[order], h=h[order], n=n[order])
                    del order
                    if length == longest:
                        continue
                    ids = np.where(ids >= 0, np.where(stay, np.cumsum(stay, dtype=np.int32) - 1, -1).astype(np.int32)[ids], -1) if len(n) else ids
                    at, ids = at[ids >= 0], ids[ids >= 0]
                    w, own = shelf.get(i, "text", "w", "own")
                    at, ids, _, n, h, lang = grown(w, own, at, ids, h[stay], lang[stay], length + 1)
                    if at is not None:
                        left.append(i)
                        shelf.put(i, "level", at=at, ids=ids, n=n.astype(np.int32), h=h, lang=lang)
                parts = -(-told // BLOCK)
                for b in range(parts):  # by ranges of the hash, so that no more than some million are held
                    k, h, n = _met(shelf, open_, (b << 64) // parts, ((b + 1) << 64) // parts - 1)
                    over = n > untold[k]  # others only share a place with these
                    yield rows(names, k[over], h[over], (n - untold[k])[over])
                open_ = left
        finally:
            shelf.close()
    return run


def _count(union, longest: int, shard_words: int, held: int = 400_000, rows: int = 20_000):
    """Second pass: counts of the union's phrases, added up over a task's shards, and the number of words as the phrase ''."""
    def told(sums):
        cells = [(lang, p, n) for lang, d in sums.items() for p, n in d.items()]
        for i in range(0, len(cells), rows):
            lang, phrase, n = zip(*cells[i:i + rows])
            size = [p.count(b" ") + 1 if p else 0 for p in phrase]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array([p.decode("utf-8", "surrogatepass") for p in phrase], pa.string()),
                 pa.array(size, pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "size", "n"])

    def run(batches):
        bits, sums = union.value, defaultdict(lambda: defaultdict(int))
        for shard in _shards(batches, shard_words):
            word, lang, langs = shard.words()
            for x in langs:
                sums[x][b""] += shard.n_words[x]
            size = 0
            for w, first, n, k in shard.levels(word, lang, langs, longest, lambda n, h, k: in_set(bits, h)):
                size += 1
                for i in range(0, len(first), rows):
                    cells = w[first[i:i + rows, None] + np.arange(size)].tolist()
                    for c, x, m in zip(cells, k[i:i + rows].tolist(), n[i:i + rows].tolist()):
                        sums[langs[x]][b" ".join([word[y] for y in c])] += m
            if sum(map(len, sums.values())) >= held:
                yield from told(sums)
                sums.clear()
        yield from told(sums)
    return run


def candidates(texts: DataFrame, totals: dict[str, int], support: int, longest: int, shard_words: int, local: int) -> DataFrame:
    """The union as 64-bit phrase codes: what shards tell, and all they may not have told, reaches the support."""
    shared = texts.sparkSession.sparkContext.broadcast(totals)
    found = texts.mapInArrow(_mine(shared, support, longest, shard_words, local), "lang string, hash long, excess long")
    found = materialize(found.groupBy("lang", "hash").agg(F.sum("excess").alias("excess")))
    untold = found.filter("hash IS NULL").select("lang", F.col("excess").alias("untold"))  # one row per language
    return found.filter("hash IS NOT NULL").join(F.broadcast(untold), "lang").filter(F.col("excess") + F.col("untold") >= support).select("hash")


def bit_set(codes: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """The codes as a bit set, sixteen places a bit at least until `most`: packed on the executors, so at most 2**(most - 6) rows reach the driver."""
    bits = min(most, max(SLOT_BITS, (32 * codes.count()).bit_length()))
    slot = F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND((1 << bits) - 1)))
    packed = codes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("place")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[packed["place"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def tellers(support: int, local: int) -> int:
    """So many tasks of the first pass at most, of even size, may each leave `local` untold; 0 if these are too few to share the work."""
    most = (support - 1) // (local + 1)
    return most if most >= FEW else 0


def frequent(docs: DataFrame, support: int = 100, longest: int = 5, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES,
             local: int = LOCAL) -> DataFrame:
    """(lang, phrase, size, n) of all phrases with n >= support; size 0 has the language's number of words."""
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), lang_column().alias("lang"))
    totals = {r.lang: r.n or 0 for r in texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    n = max(spark.sparkContext.defaultParallelism, -(-sum(totals.values()) // shard_bytes))
    found = candidates(texts.coalesce(min(n, tellers(support, local) or n)), totals, support, longest, shard_words, local)
    union, texts = spark.sparkContext.broadcast(bit_set(found)), texts.coalesce(n)
    counts = texts.mapInArrow(_count(union, longest, shard_words), "lang string, phrase string, size int, n long")
    return counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= support) | (F.col("size") == 0))


def _part(first: bool) -> Column:
    """The first k words of the phrase, or the rest."""
    return F.expr("substring_index(phrase, ' ', k)") if first else F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")


def _with_count(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Count of a part. A part may begin a large share of all phrases, so rows are salted and the counts repeated."""
    side = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.hash("phrase", "k"), F.lit(SALTS))).join(side, ["lang", part, "salt"]).drop("salt")


def scored(counts: DataFrame, covered_percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer candidate covers.

    A longer candidate covers one inside it from `covered_percent` of its count on.
    Counts cannot grow with length, so the candidates one word longer decide.
    """
    phrases = counts.filter("size > 1").withColumnRenamed("n", "a")
    inner = [F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")]
    longer = (phrases.filter("size > 2").select("lang", F.explode(F.array_distinct(F.array(*inner))).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    open_ = phrases.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))).drop("longer")
    cut = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"head": _part(True), "tail": _part(False), "all": F.lit("")})
    for part, name in (("head", "l"), ("tail", "r"), ("all", "n_words")):
        cut = _with_count(cut, counts, part, name)
    d = {c: f"CAST({c} AS DECIMAL(19,0))" for c in ("a", "l", "r", "n_words")}
    cut = cut.withColumn("score", F.expr(f"(1000 * {d['a']} * {d['n_words']}) div ({d['l']} * {d['r']})"))
    best = cut.groupBy("lang", "phrase", "a", "n_words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("n_words").alias("n"), "cut.score")


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of each language with their rank: salted parts first, then their leaders."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    near = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= limit)
    return near.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, limit: int = 2_000, covered_percent: int = 100,
                 shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first `limit` phrases of 2 to `longest` words by the score of their weakest cut."""
    counts = materialize(frequent(docs, support, longest, shard_words, shard_bytes))
    return top(scored(counts, covered_percent), limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
