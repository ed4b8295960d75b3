"""Exact ranks per group without handing a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import attach, join_on
from ..functions.hashing import HASH_BUCKETS, hash_bucket
from ..session import is_small, materialize

# A group is cut into at most this many ordered value ranges.
RANGE_BUCKETS = 65536
# Cells per level where ranges are cut twice.
CELLS = 4096
ROW_CELLS = 1024
# Stand-in for infinity when ranges are measured.
MAX = 1.7976931348623157e308


def _preceding(keys: Sequence[str], order: str):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def buckets_before(df: DataFrame, by: Sequence[str], bucket: str, count: Column | None = None,
                   extra: Sequence[Column] = ()) -> DataFrame:
    """Rows (or summed `count`) of each bucket's predecessors within its group.

    The counting shuffle carries one row per (group, bucket) and map task; the
    window then sees at most as many rows per group as there are buckets.
    """
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    per = df.groupBy(*by, bucket).agg(n.alias("__in"), *extra)
    return per.withColumn("__before", F.coalesce(F.sum("__in").over(_preceding(by, bucket)), F.lit(0)))


def add_before(rows: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give rows the `__before` of their bucket, and the bucket as one column `__key`.

    The keys travel as a struct, under which NULLs are equal: the join and a
    window over `__key` then share one shuffle (none of the rows, where the
    bucket table is small enough for Spark to broadcast it).
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__key")
    return rows.select("*", key).join(before.select(key, "__before"), "__key")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: Column,
           name: str = "rank", limit: int | Column | None = None,
           small_bytes: int | None = None) -> DataFrame:
    """1-based row number per group in the given total order.

    `bucket` must be non-decreasing along the order. Beyond the small size the
    rank is the row count of the earlier buckets plus the row number inside
    the own bucket, so no task sorts more than one bucket. With `limit`
    (number, or a column that is constant per group) only the leading rows
    stay, and buckets wholly behind the limit are dropped before the sort.
    """
    lim = F.lit(limit) if isinstance(limit, int) else limit
    if is_small(df, small_bytes):
        w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)
        out = df.withColumn(name, F.row_number().over(w).cast("bigint"))
        return out if lim is None else out.where(F.col(name) <= lim)
    cut = df.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    if lim is None:
        before = buckets_before(cut, by, "__bucket")
    else:
        before = buckets_before(cut.withColumn("__lim", lim), by, "__bucket", extra=[F.max("__lim").alias("__lim")])
        before = before.where(F.col("__before") < F.col("__lim"))
    if not by:
        # one group: no more rows than there are buckets
        before = F.broadcast(before)
    w = Window.partitionBy("__key").orderBy(*order)
    out = add_before(cut, before, keys).withColumn(name, F.col("__before") + F.row_number().over(w))
    if lim is not None:
        out = out.where(F.col(name) <= lim)
    return out.drop("__key", "__bucket", "__before")


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, tie: Sequence[str] = (), name: str = "rank",
                limit: int | Column | None = None, small_bytes: int | None = None) -> DataFrame:
    """Rank in the order of an md5 draw-key column: a random order per group."""
    return ranked(df, by, [key, *tie], hash_bucket(F.col(key)), name, limit, small_bytes)


def hash_flagged(df: DataFrame, by: Sequence[str], key: str, limit: Column, tie: Sequence[str] = (), name: str = "flag",
                 small_bytes: int | None = None) -> DataFrame:
    """Flag the rows whose rank in the order of a draw key is at most `limit`, an expression over the group's size `__n`.

    Beyond the small size the bucket counts of a group name its border bucket,
    the one in which the limit falls. All other buckets are flagged as they are
    read, without a sort or shuffle of the rows; only border rows are ranked.
    """
    if is_small(df, small_bytes):
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        return attach(hash_ranked(df, by, key, tie, "__r", small_bytes=small_bytes), sizes, by).withColumn(name, F.col("__r") <= limit).drop("__r", "__n")
    cut = df.withColumn("__bucket", hash_bucket(F.col(key)))
    before = buckets_before(cut, by, "__bucket")
    sizes = before.groupBy(*by).agg(F.sum("__in").alias("__n"))
    left = (limit - F.col("__before")).alias("__left")
    border = attach(before, sizes, by).select(*by, "__bucket", "__in", left).where("__left >= 0")
    # the last bucket that begins before the limit; its rows up to `__left` are flagged, those of all before it wholly
    last = border.groupBy(*by).agg(F.max_by(F.struct("__bucket", "__left"), "__bucket").alias("__at"))
    seen = attach(cut, last, by, "left").withColumns({"__edge": F.col("__at.__bucket"), "__left": F.col("__at.__left")}).drop("__at")
    inside = F.coalesce(F.col("__bucket") == F.col("__edge"), F.lit(False))
    plain = seen.where(~inside).withColumn(name, F.coalesce(F.col("__bucket") < F.col("__edge"), F.lit(False)))
    w = Window.partitionBy(*by).orderBy(key, *tie)
    edge = seen.where(inside).withColumn(name, F.row_number().over(w) <= F.col("__left"))
    return plain.unionByName(edge).drop("__bucket", "__edge", "__left")


def hash_marked(df: DataFrame, by: Sequence[str], key: str, limit: Column, tie: Sequence[str] = (), name: str = "flag",
                small_bytes: int | None = None) -> DataFrame:
    """`hash_flagged` for frames that are flagged several times.

    Beyond the small size the bucket counts of a group name its border bucket,
    the one in which the limit falls, and the rows of that bucket the last row
    to be flagged. Both are found when called and leave one row per group, so
    that all rows are flagged as they are read, without a sort or shuffle, and
    a frame that is flagged several times is still read once.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    if is_small(df, small_bytes):
        sized = df.withColumns({"__n": F.count(F.lit(1)).over(group), "__r": F.row_number().over(group.orderBy(key, *tie))})
        return sized.withColumn(name, F.col("__r") <= limit).drop("__r", "__n")
    cut = df.select(*by, F.struct(key, *tie).alias("__at"), hash_bucket(F.col(key)).alias("__bucket"))
    before = materialize(buckets_before(cut, by, "__bucket"))
    sizes = before.groupBy(*by).agg(F.sum("__in").alias("__n"))
    left = (limit - F.col("__before")).alias("__left")
    border = attach(before, sizes, by).select(*by, "__bucket", "__in", left).where("__left > 0")
    # the last bucket that begins before the limit: its rows up to `__left` are flagged, those of all before it wholly
    border = border.groupBy(*by).agg(F.max_by(F.struct("__bucket", "__left"), "__bucket").alias("__b")).select(*by, "__b.*")
    inside = materialize(join_on(cut, materialize(border), [*by, "__bucket"]).withColumn("__r", F.row_number().over(group.orderBy("__at"))))
    last = inside.where(F.col("__r") <= F.col("__left")).groupBy(*by).agg(F.max("__at").alias("__last"), F.max("__r").alias("__in"))
    # rows that equal the last one in key and tie and lie behind the limit
    equal = join_on(inside, last, by).where((F.col("__at") == F.col("__last")) & (F.col("__r") > F.col("__in")))
    beyond = equal.groupBy(*by).agg(F.count(F.lit(1)).alias("__beyond"))
    last = materialize(join_on(last, beyond, by, "left").drop("__in"))
    at = F.struct(key, *tie)
    seen = join_on(df, last, by, "left") if by else df.crossJoin(F.broadcast(last))
    ahead = F.coalesce(at <= F.col("__last"), F.lit(False))
    if last.where("__beyond > 0").isEmpty():
        return seen.withColumn(name, ahead).drop("__last", "__beyond")
    tied = F.coalesce((at == F.col("__last")) & (F.col("__beyond") > 0), F.lit(False))
    some = seen.where(tied).withColumns({"__k": F.count(F.lit(1)).over(group), "__r": F.row_number().over(group.orderBy(key))})
    some = some.withColumn(name, F.col("__r") <= F.col("__k") - F.col("__beyond")).drop("__k", "__r")
    return seen.where(~tied).withColumn(name, ahead).unionByName(some).drop("__last", "__beyond")


def hash_cell(key: Column) -> Column:
    """Leading 8 bits of a draw key: few enough to be counted for every group and key at once."""
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("smallint")


def hash_marked_all(df: DataFrame, by: Sequence[str], marks: Sequence[tuple[str, Column]], limit: Column, tie: Sequence[str] = (),
                    cells: Sequence[str] | None = None) -> DataFrame:
    """`hash_marked` beyond the small size for several (flag, draw key) at once, in two reads of the rows before they are flagged.

    `cells` names columns that hold the `hash_cell` of each draw key, so that a
    key is worked out for the rows of the border cells alone. One read counts the
    cells of all keys; the second ranks the rows of the border cells.
    """
    rows, names = df, [name for name, _ in marks]
    if cells is None:
        cells = [f"__c{i}" for i in range(len(marks))]
        rows = df.withColumns({c: hash_cell(key) for c, (_, key) in zip(cells, marks)})
    kept, one = [*by, "__mark"], range(len(marks))
    seen = rows.select(*by, F.posexplode(F.array(*cells)).alias("__mark", "__cell"))
    before = materialize(buckets_before(seen, kept, "__cell"))
    sizes = before.groupBy(*kept).agg(F.sum("__in").alias("__n"))
    border = attach(before, sizes, kept).select(*kept, "__cell", (limit - F.col("__before")).alias("__left")).where("__left > 0")
    border = border.groupBy(*kept).agg(F.max_by(F.struct("__cell", "__left"), "__cell").alias("__b"))

    def abreast(per_mark: DataFrame, value: str) -> DataFrame:
        return materialize(per_mark.groupBy(*by).agg(*[F.max(F.when(F.col("__mark") == i, F.col(value))).alias(f"{value}{i}") for i in one]))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return join_on(left, right, by, "left") if by else left.crossJoin(F.broadcast(right))

    at = [F.struct(key.alias("__k"), *tie) for _, key in marks]
    edged = met(rows, abreast(border, "__b"))
    on_edge = [F.coalesce(F.col(c) == F.col(f"__b{i}.__cell"), F.lit(False)) for i, c in enumerate(cells)]
    inside = edged.where(reduce(or_, on_edge)).select(*by, F.explode(F.array_compact(F.array(*[
        F.when(on_edge[i], F.struct(F.lit(i).alias("__mark"), at[i].alias("__at"), F.col(f"__b{i}.__left").alias("__left"))) for i in one]))).alias("__e"))
    group = Window.partitionBy(*kept).orderBy("__at")
    inside = materialize(inside.select(*by, "__e.*").withColumn("__r", F.row_number().over(group)))
    last = inside.where(F.col("__r") <= F.col("__left")).groupBy(*kept).agg(F.max("__at").alias("__last"), F.max("__r").alias("__in"))
    equal = join_on(inside, last, kept).where((F.col("__at") == F.col("__last")) & (F.col("__r") > F.col("__in")))
    beyond = equal.groupBy(*kept).agg(F.count(F.lit(1)).alias("__beyond"))
    last = join_on(last, beyond, kept, "left").select(*kept, F.struct("__last", "__beyond").alias("__e"))
    last = abreast(last, "__e")
    full = met(edged, last)
    ahead = [F.coalesce(F.when(on_edge[i], at[i] <= F.col(f"__e{i}.__last")).otherwise(F.col(c) < F.col(f"__b{i}.__cell")), F.lit(False)) for i, c in enumerate(cells)]
    flags = dict(zip(names, ahead))
    out = [*df.columns, *names]
    split = [i for i in one if not last.where(f"__e{i}.__beyond > 0").isEmpty()]
    if not split:
        return full.withColumns(flags).select(*out)
    tied = {i: on_edge[i] & F.coalesce((at[i] == F.col(f"__e{i}.__last")) & (F.col(f"__e{i}.__beyond") > 0), F.lit(False)) for i in split}
    any_tied = reduce(or_, tied.values())
    some = full.where(any_tied).withColumns(flags)
    for i in split:
        w = Window.partitionBy(*by, tied[i])
        some = some.withColumns({"__k": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy(marks[i][1]))})
        some = some.withColumn(names[i], F.when(tied[i], F.col("__r") <= F.col("__k") - F.col(f"__e{i}.__beyond")).otherwise(F.col(names[i])))
    return full.where(~any_tied).withColumns(flags).select(*out).unionByName(some.select(*out))


def hash_picked(df: DataFrame, by: Sequence[str], key: str, wanted: DataFrame, position: str, tie: Sequence[str] = (),
                small_bytes: int | None = None) -> DataFrame:
    """The rows at the wanted positions (per group, from 1) of the order of a draw key, each as often as it is wanted.

    `wanted` has the columns of `by`, the position and any more. Beyond the small
    size a position is looked up in the bucket counts first; only rows of buckets
    that some position hits are ranked and shuffled.
    """
    if is_small(df, small_bytes):
        rows = hash_ranked(df, by, key, tie, "__pos", small_bytes=small_bytes)
        return join_on(wanted.withColumnRenamed(position, "__pos"), rows, [*by, "__pos"]).drop("__pos")
    cut = df.withColumn("__bucket", hash_bucket(F.col(key)))
    before = buckets_before(cut, by, "__bucket")
    sizes = before.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.sum("__in") / F.lit(HASH_BUCKETS))).alias("__width"))
    # positions are cut into cells as wide as an average bucket, so that bucket and position meet by equality
    spans = attach(before, sizes, by)
    cells = F.sequence(F.floor((F.col("__before") + 1) / F.col("__width")), F.floor((F.col("__before") + F.col("__in")) / F.col("__width")))
    index = spans.select(*by, "__bucket", "__before", "__in", F.explode(cells).alias("__cell"))
    asked = attach(wanted, sizes, by).withColumn("__cell", F.floor(F.col(position) / F.col("__width"))).drop("__width")
    found = join_on(asked, index, [*by, "__cell"]).where(
        (F.col(position) > F.col("__before")) & (F.col(position) <= F.col("__before") + F.col("__in")))
    found = found.withColumn("__r", (F.col(position) - F.col("__before")).cast("int")).drop(position, "__before", "__in", "__cell")
    hit = found.select(*by, "__bucket").distinct()
    w = Window.partitionBy(*by, "__bucket").orderBy(key, *tie)
    rows = join_on(cut, hit, [*by, "__bucket"], "left_semi").withColumn("__r", F.row_number().over(w))
    return join_on(found, rows, [*by, "__bucket", "__r"]).drop("__bucket", "__r")


def squash(v: Column) -> Column:
    """Order-keeping signed logarithm, finite for infinities: spreads long tails."""
    t = F.signum(v) * F.ln(F.lit(1.0) + F.abs(v))
    return F.greatest(F.lit(-710.0), F.least(F.lit(710.0), t))


def with_value_bucket(df: DataFrame, by: Sequence[str], value: str, name: str = "__bucket",
                      buckets: int = RANGE_BUCKETS, linear: bool = False,
                      stats: Sequence[Column] = ()) -> DataFrame:
    """Add an order-keeping bucket of `value` within its group's own range.

    The range is one row per group; rows meet it by a broadcast or shuffled
    join, whichever its size allows. `stats` are extra aggregates to attach.
    """
    t = F.greatest(F.lit(-MAX), F.least(F.lit(MAX), F.col(value))) if linear else squash(F.col(value))
    span = df.groupBy(*by).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"), *stats)
    lo, hi = F.col("__lo"), F.col("__hi")
    # halved, so that the width of the widest range stays finite
    part = F.floor((t / 2 - lo / 2) / (hi / 2 - lo / 2) * F.lit(float(buckets)))
    b = F.when(hi / 2 > lo / 2, F.least(F.lit(buckets - 1), part.cast("int"))).otherwise(F.lit(0))
    return attach(df, span, by).withColumn(name, b).drop("__lo", "__hi")


def first_rows(df: DataFrame, n: int, order: str, by: Sequence[str] = (),
               small_bytes: int | None = None) -> DataFrame:
    """The first n rows per group (or overall) by a numeric arrival column; rows without one come first."""
    if is_small(df, small_bytes):
        return ranked(df, by, [order], F.lit(0), "__rank", n).drop("__rank")
    # two levels: a far outlier leaves all other rows in one cell of the first, which the second spreads
    outer = with_value_bucket(df.withColumn("__v", F.col(order).cast("double")), by, "__v", "__v1", ROW_CELLS)
    cut = with_value_bucket(outer, [*by, "__v1"], "__v", "__v2", ROW_CELLS, linear=True)
    # a missing value has a bucket before all others, as it sorts before them
    cell = F.when(F.col("__v").isNull(), F.lit(-1)).otherwise(F.col("__v1") * ROW_CELLS + F.col("__v2"))
    out = ranked(cut, by, [order], cell, "__rank", n, small_bytes)
    return out.drop("__rank", "__v", "__v1", "__v2")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None,
                  small_bytes: int | None = None) -> DataFrame:
    """(by, value, avg_rank): rank of each distinct value, ties sharing their mean rank.

    Equal values are counted first, so a value held by a third of all rows is
    one row from the first shuffle on. Beyond the small size the counts are
    written, as both levels of ranges start from them.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*by, value).agg(n.alias("__n"))
    if is_small(df, small_bytes):
        prev = F.coalesce(F.sum("__n").over(_preceding(by, value)), F.lit(0))
        out = counts.withColumn("__prev", prev)
    else:
        counts = materialize(counts)
        # two levels, each within its own range: a crowd of close values next to
        # far outliers is one cell of the first level and spread by the second
        outer = with_value_bucket(counts, by, value, "__b1", CELLS)
        cut = with_value_bucket(outer, [*by, "__b1"], value, "__b2", CELLS, linear=True)
        inner = buckets_before(cut, [*by, "__b1"], "__b2", F.col("__n"))
        first = buckets_before(inner, by, "__b1", F.col("__in")).withColumnRenamed("__before", "__before1").drop("__in")
        cells = join_on(inner, first, [*by, "__b1"]).withColumn("__before", F.col("__before") + F.col("__before1"))
        inside = F.coalesce(F.sum("__n").over(_preceding(["__key"], value)), F.lit(0))
        out = add_before(cut, cells, [*by, "__b1", "__b2"]).withColumn("__prev", F.col("__before") + inside)
    return out.select(*by, value, (F.col("__prev") + (F.col("__n") + 1) / F.lit(2.0)).alias("avg_rank"))
