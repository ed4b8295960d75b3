"""Sharding by fixed virtual slots (operator 2).

A record's hash decides its slot out of a few thousand; the slot never changes.
Bytes and rows are summed per slot, and a slot-to-shard map deals the slots out
so that shards hold near equal bytes. The map is a small versioned table:
rebalancing and new shards edit it, moving single slots, and every version stays
readable. The map has one row per slot, so the driver may hold it at any input.

Law of the query: `bytes`. Null texts count 16 bytes and crc32 0. Rows equal in
id and text share a slot. A null id is hashed with its text like any other. An
empty table has an empty result and a map of empty slots. Only the id and the
text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

SLOTS = 8192
OVERHEAD = 16
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row, written once."""
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc)
    return materialize(base.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")))


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot; `slots` rows on the driver."""
    sums = [(0, 0)] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sums[r.virtual_slot] = (r.b, r.n)
    return sums


def first_map(sums: list[tuple[int, int]], shards: int) -> list[int]:
    """Largest slots first, each to the shard with the fewest bytes so far."""
    owner, load = [0] * len(sums), [(0, k) for k in range(shards)]
    for slot in sorted(range(len(sums)), key=lambda s: (-sums[s][0], s)):
        used, k = heapq.heappop(load)
        owner[slot] = k
        heapq.heappush(load, (used + sums[slot][0], k))
    return owner


def rebalanced(owner: list[int], sums: list[tuple[int, int]], shards: int, tolerance: float = 0.02) -> list[int]:
    """Move single slots from the fullest to the emptiest shard until all are within `tolerance` of the mean.

    A larger number of shards than before adds empty ones, which fill up alike.
    Moves only what lowers the gap, so it ends, and leaves all other slots alone.
    """
    owner = list(owner)
    load, slots = [0] * shards, [[] for _ in range(shards)]
    for s, k in enumerate(owner):
        load[k] += sums[s][0]
        slots[k].append(s)
    mean = sum(load) / shards
    while True:
        full, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[low]
        if load[full] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            return owner
        fits = [s for s in slots[full] if 0 < sums[s][0] < gap]
        if not fits:
            return owner
        s = min(fits, key=lambda s: (abs(gap / 2 - sums[s][0]), s))
        owner[s] = low
        slots[full].remove(s)
        slots[low].append(s)
        load[full] -= sums[s][0]
        load[low] += sums[s][0]


def write_map(spark: SparkSession, path: str, version: int, owner: list[int], sums: list[tuple[int, int]]) -> None:
    """Add a version to the map table; earlier versions are not touched. Fails if the version is there."""
    rows = [(version, s, k, *sums[s]) for s, k in enumerate(owner)]
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default."""
    found = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.filter(F.col("version") == version)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position of every record: its slot's start in the shard, and its place in the slot."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("shard", F.col("slot").alias("virtual_slot"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(starts), "virtual_slot")
    return out.withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at")
