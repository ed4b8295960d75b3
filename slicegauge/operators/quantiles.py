"""Exact interpolated quantiles of many columns, per group, in one plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_double, attach, join_on, melt
from ..session import is_small, materialize


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), small_bytes: int | None = None) -> DataFrame:
    """(by, column, n, q array): linear interpolation between order statistics.

    Small inputs use `percentile`, which keeps a value map per group. Larger
    ones find the value range that holds each wanted rank from two levels of
    bucket counts (two jobs that run at once) and sort only the distinct values
    of those ranges, so neither a map nor a task ever holds a column. Both give
    the same rows: missing values are left out, a group without values has no
    row, zero has no sign.
    """
    probs = [float(p) for p in probs]
    if is_small(df, small_bytes):
        ps = F.array(*[F.lit(p) for p in probs])
        aggs, cells = [], []
        for i, c in enumerate(columns):
            v = as_double(df, c) + F.lit(0.0)
            aggs += [F.count(v).alias(f"__n{i}"), F.percentile(v, ps).alias(f"__q{i}")]
            cells.append(F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n"),
                                  F.col(f"__q{i}").alias("q")))
        return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells))).where("n > 0")
    return _by_buckets(df, columns, probs, list(by))


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                          rank_error: float = 0.001) -> DataFrame:
    """(by, column, n, q array) within `rank_error` * n ranks: one pass, one mergeable sketch per group and column.

    The sketch (Greenwald and Khanna, as in `percentile_approx`) holds about 1 / `rank_error`
    values, is built in the map tasks and merged, so neither hot groups nor hot values
    matter. The values are members of the column, not interpolated; missing ones are left out.
    """
    if not 0 < rank_error < 1:
        raise ValueError("rank_error must lie between 0 and 1")
    ps = F.array(*[F.lit(float(p)) for p in probs])
    aggs, cells = [], []
    for i, c in enumerate(columns):
        v = as_double(df, c) + F.lit(0.0)
        aggs += [F.count(v).alias(f"__n{i}"), F.percentile_approx(v, ps, math.ceil(1 / rank_error)).alias(f"__q{i}")]
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n"), F.col(f"__q{i}").alias("q")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells))).where("n > 0")


def rank_errors(df: DataFrame, quantiles: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, prob, error): how far each value's ranks miss prob * n, as a share of n; for judging a sketch."""
    wide = quantiles.groupBy(*by).agg(*[F.first(F.when(F.col("column") == c, F.col("q")), ignorenulls=True).alias(f"__q{i}") for i, c in enumerate(columns)])
    rows, aggs, cells = attach(df.select(*by, *[as_double(df, c).alias(f"__v{i}") for i, c in enumerate(columns)]), wide, by), [], []
    for i, c in enumerate(columns):
        aggs.append(F.count(f"__v{i}").alias(f"__n{i}"))
        for j, p in enumerate(probs):
            q = F.col(f"__q{i}")[j]
            aggs += [F.count_if(F.col(f"__v{i}") < q).alias(f"__lt{i}_{j}"), F.count_if(F.col(f"__v{i}") <= q).alias(f"__le{i}_{j}")]
            n, want = F.col(f"__n{i}"), F.lit(float(p)) * F.col(f"__n{i}")
            miss = F.greatest(F.lit(0.0), F.col(f"__lt{i}_{j}") - want, want - F.col(f"__le{i}_{j}"))
            cells.append(F.struct(F.lit(c).alias("column"), n.alias("n"), F.lit(float(p)).alias("prob"), F.try_divide(miss, n).alias("error")))
    return rows.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells))).where("n > 0")


# Buckets per factor e of magnitude, and cells into which a wanted bucket is cut.
PER_E = 40
CELLS = 4096


def _magnitude(v: Column) -> Column:
    """Bucket of a double by sign and logarithm: never falls as the value rises, under 120,002 buckets, no range needed."""
    # ln of the smallest double is above -746; the infinities get buckets of their own
    m = F.coalesce(F.ln(F.abs(v)) + 746.0, F.lit(0.0)) * F.signum(v) * PER_E
    return F.floor(F.greatest(F.lit(-60000.0), F.least(F.lit(60000.0), m))).cast("int")


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """Zero-based ranks on both sides of each quantile position."""
    pos = [(n - 1) * F.lit(p) for p in probs]
    return F.array_distinct(F.array(*[f(x).cast("bigint") for x in pos for f in (F.floor, F.ceil)]))


def _holding(counts: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """The buckets that hold a wanted rank, with the rows in front of them (`__base`) and the ranks they hold (`__want`).

    At most one row per wanted rank and group is left; written once, so that Spark
    knows how small it is when the rows are joined with it.
    """
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum("__in").over(before), F.lit(0))
    held = F.filter("__want", lambda i: (i >= F.col("__start")) & (i < F.col("__start") + F.col("__in")))
    out = counts.withColumn("__start", start).withColumn("__want", held).where(F.size("__want") > 0)
    return materialize(out.drop("__base", "__in").withColumnRenamed("__start", "__base"))


def _by_buckets(df: DataFrame, columns: Sequence[str], probs: list[float], by: list[str]) -> DataFrame:
    """Three passes over the rows: bucket counts, cell counts inside the wanted buckets, the values of the wanted cells.

    The first two run when called and leave one small table each.
    """
    g = [*by, "column"]
    long = melt(df, by, {c: as_double(df, c) + F.lit(0.0) for c in columns}).where(F.col("value").isNotNull())
    long = long.withColumn("__b", _magnitude(F.col("value")))
    sums = [F.count(F.lit(1)).alias("__in"), F.min("value").alias("__lo"), F.max("value").alias("__hi")]
    top = long.groupBy(*g, "__b").agg(*sums).withColumn("n", F.sum("__in").over(Window.partitionBy(*g)))
    top = top.withColumns({"__base": F.lit(0).cast("bigint"), "__want": _ranks(F.col("n"), probs)})
    top = _holding(top, g, "__b")
    width = F.col("__hi") - F.col("__lo")
    cell = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("value") - F.col("__lo")) / width * CELLS).cast("int")).otherwise(0)
    # what a bucket carries is the same in all its rows
    carried = [F.first(c).alias(c) for c in ("n", "__base", "__want")]
    cells = join_on(long, top, [*g, "__b"]).withColumn("__c", cell).groupBy(*g, "__b", "__c").agg(*sums, *carried)
    cells = _holding(cells, [*g, "__b"], "__c")
    inside = join_on(long, cells, [*g, "__b"]).where(F.col("value").between(F.col("__lo"), F.col("__hi")))
    # equal values collapse map-side, so a hot value is one row in the window
    keys = [*g, "__b", "__c"]
    counts = inside.groupBy(*keys, "n", "__base", "__want", "value").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum("__k").over(w), F.lit(0))
    hits = (counts.withColumn("__start", start)
            .withColumn("__hit", F.filter("__want", lambda i: (i >= F.col("__start"))
                                          & (i < F.col("__start") + F.col("__k"))))
            .where(F.size("__hit") > 0)
            .select(*g, "n", F.explode("__hit").alias("i"), "value"))
    # at most two order statistics per probability and group
    found = hits.groupBy(*g, "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("__m"))
    q = []
    for x in [(F.col("n") - 1) * F.lit(p) for p in probs]:
        lo, hi = F.floor(x).cast("bigint"), F.ceil(x).cast("bigint")
        a, b = F.col("__m")[lo], F.col("__m")[hi]
        q.append(F.when(a == b, a).otherwise((hi - x) * a + (x - lo) * b))
    return found.select(*g, "n", F.array(*q).alias("q"))
