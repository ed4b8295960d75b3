"""Reproducible sampling and the slicing strategies.

All draws follow md5 orders of (seed, purpose, row key), so a slice is the
same set of rows whatever the partitioning. Slices may overlap; each operator
returns one long frame with a `slice` column.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import join_on
from ..functions.hashing import draw_int, draw_key
from ..session import is_small
from .ranking import first_rows, hash_cell, hash_flagged, hash_marked, hash_marked_all, hash_picked, hash_ranked


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42, by: Sequence[str] = (),
                purpose: str = "sample", small_bytes: int | None = None) -> DataFrame:
    """n rows without replacement, per group if `by` is given; all if fewer."""
    keyed = df.withColumn("__k", draw_key(seed, purpose, F.col(key)))
    return hash_ranked(keyed, by, "__k", [key], "__r", n, small_bytes).drop("__k", "__r")


def slice_by_key(df: DataFrame, column: str, key: str, values: Sequence[Any] | None = None,
                 cap: int | None = None, seed: int = 42, prefix: str = "", suffix: str = "",
                 small_bytes: int | None = None) -> DataFrame:
    """One slice per listed value; a slice above the cap is sampled down to it."""
    out = df if values is None else df.where(F.col(column).isin(*values))
    if cap is not None:
        out = hash_sample(out, cap, key, seed, [column], "cap", small_bytes)
    return out.withColumn("slice", F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(suffix)))


def slice_by_cohort(df: DataFrame, column: str, key: str, cohorts: Sequence[str] | None = None,
                    min_rows: int = 1000, cap: int | None = None, seed: int = 42, prefix: str = "",
                    small_bytes: int | None = None) -> DataFrame:
    """One slice per cohort with enough rows; large ones are sampled to the cap."""
    pool = df if cohorts is None else df.where(F.col(column).isin(*cohorts))
    size = (pool.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_rows))
    kept = F.col("__n") if cap is None else F.least(F.col("__n"), F.lit(cap))
    rows = hash_sample(pool, cap, key, seed, [column], "cap", small_bytes) if cap is not None else pool
    named = join_on(rows, size, [column])
    name = F.concat(F.lit(prefix), F.col(column), F.lit("_n"), kept.cast("string"))
    return named.withColumn("slice", name).drop("__n")


def slice_by_ranges(df: DataFrame, column: str, groups: Sequence[Sequence[int]], prefix: str = "") -> DataFrame:
    """Inclusive value ranges that may overlap; a row joins every range it is in.

    The ranges are the caller's list, so membership is a row-wise explode and
    needs no join.
    """
    cells = []
    for i, g in enumerate(groups):
        lo, hi = g[0], g[-1]
        hit = F.col(column).between(lo, hi)
        cells.append(F.when(hit, F.lit(f"{prefix}{lo}_{hi}_slice_{i:02d}")))
    return df.withColumn("slice", F.explode(F.array_compact(F.array(*cells))))


def _sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """Rows with label 1 and 0: two fitted numbers, read once on the driver."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return row["p"], row["n"]


def _half_even(x: float) -> int:
    return int(round(x))


def _with_replacement(df: DataFrame, label: str, key: str, plan: Sequence[tuple[str, int, int, int]],
                      seed: int, small_bytes: int | None) -> DataFrame:
    """Draws of `plan` entries (slice, label value, number of draws, pool size).

    Draw numbers come from a distributed range; each draw's hash names a
    position in its pool, which `hash_picked` looks up.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__k", draw_key(seed, "position", F.col(key)))
    start, parts = 0, []
    name, lab, size, first = [F.lit(None)] * 4
    for sl, value, n, pool in plan:
        inside = (F.col("id") >= start) & (F.col("id") < start + n)
        name = F.when(inside, F.lit(sl)).otherwise(name)
        lab = F.when(inside, F.lit(value)).otherwise(lab)
        size = F.when(inside, F.lit(pool).cast("bigint")).otherwise(size)
        first = F.when(inside, F.lit(start).cast("bigint")).otherwise(first)
        start += n
        parts.append(n)
    draws = spark.range(start).select(name.alias("slice"), lab.cast("int").alias("__lab"),
                                      size.alias("__size"), (F.col("id") - first + 1).alias("draw"))
    hit = draw_int(draw_key(seed, "draw", F.col("slice"), F.col("__lab"), F.col("draw"))) % F.col("__size") + 1
    draws = draws.select("slice", "draw", F.col("__lab").cast(df.schema[label].dataType).alias(label), hit.alias("__hit"))
    return hash_picked(keyed, [label], "__k", draws, "__hit", [key], small_bytes).drop("__k")


def stratified_bootstrap(df: DataFrame, label: str, key: str, sizes: Sequence[int], seed: int = 42,
                         prefix: str = "", small_bytes: int | None = None) -> DataFrame:
    """Slices of the given sizes drawn with replacement, label balance kept.

    Adds `slice` and `draw`; label 1 gets round-half-even(n * share) draws.
    """
    pos, neg = _sizes(df, label)
    if not pos + neg:
        raise ValueError("no labelled rows to draw from")
    plan = []
    for i, n in enumerate(sizes):
        n_pos = _half_even(n * (pos / (pos + neg)))
        name = f"{prefix}slice_{i:02d}_n{n}"
        plan += [(name, 1, n_pos, pos), (name, 0, n - n_pos, neg)]
    return _with_replacement(df, label, key, [p for p in plan if p[2] > 0], seed, small_bytes)


def slice_by_label_share(df: DataFrame, label: str, key: str, shares: Sequence[float], n: int,
                         seed: int = 42, prefix: str = "", small_bytes: int | None = None) -> DataFrame:
    """Slices of n rows with the given shares of label 1.

    Each pool is sampled without replacement, or with it when the pool is too
    small for the slice. Adds `slice` and `draw` (1 where drawn once).
    """
    pools = dict(zip((1, 0), _sizes(df, label)))
    keep, again = [], []
    for i, p in enumerate(shares):
        want = {1: _half_even(n * p)}
        want[0] = n - want[1]
        name = f"{prefix}p{int(p * 100):03d}_slice_{i:02d}"
        for value in (1, 0):
            if 0 < want[value] <= pools[value]:
                keep.append((name, value, want[value]))
            elif want[value] > pools[value] > 0:
                again.append((name, value, want[value], pools[value]))
    out = None
    if keep:
        # every row competes in each slice that samples its pool
        cells = F.array(*[F.when(F.col(label) == v, F.struct(F.lit(s).alias("slice"), F.lit(k).alias("__want")))
                          for s, v, k in keep])
        rows = df.withColumn("__s", F.explode(F.array_compact(cells)))
        rows = rows.withColumns({"slice": F.col("__s.slice"), "__want": F.col("__s.__want")}).drop("__s")
        rows = rows.withColumn("__k", draw_key(seed, "share", F.col("slice"), F.col(key)))
        out = hash_ranked(rows, ["slice", label], "__k", [key], "__r", F.col("__want"), small_bytes)
        out = out.withColumn("draw", F.lit(1).cast("bigint")).drop("__k", "__r", "__want")
    if again:
        more = _with_replacement(df, label, key, again, seed, small_bytes)
        out = more if out is None else out.unionByName(more)
    if out is None:
        raise ValueError("no labelled rows to draw from")
    return out


def slice_manifest(slices: DataFrame, label: str = "label") -> DataFrame:
    """(slice, n_rows, n_toxic, filename): one line per packaged slice."""
    return slices.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("n_toxic"),
    ).withColumn("filename", F.concat("slice", F.lit(".parquet")))


def stratified_split(df: DataFrame, label: str, key: str, seed: int, test_size: float = 0.2,
                     by: Sequence[str] = (), name: str = "is_test",
                     small_bytes: int | None = None) -> DataFrame:
    """Flag the test rows: the first share of every (group, class) in md5 order."""
    keyed = df.withColumn("__k", draw_key(seed, "split", F.col(key)))
    n_test = F.bround(F.col("__n") * F.lit(float(test_size)), 0)
    return hash_flagged(keyed, [*by, label], "__k", n_test, [key], name, small_bytes).drop("__k")


def split_cells(key: str, seeds: Sequence[int]) -> list[Column]:
    """What `stratified_splits` takes as `cells`: worked out where the rows are written, the draws need not be taken again."""
    return [hash_cell(draw_key(seed, "split", F.col(key))) for seed in seeds]


def stratified_splits(df: DataFrame, label: str, key: str, seeds: Sequence[int], names: Sequence[str], test_size: float = 0.2,
                      by: Sequence[str] = (), small_bytes: int | None = None, cells: Sequence[str] | None = None) -> DataFrame:
    """The flags of `stratified_split` for several seeds, each under its name: the rows are read once, however many seeds."""
    n_test = F.bround(F.col("__n") * F.lit(float(test_size)), 0)
    if seeds and not is_small(df, small_bytes):
        marks = [(name, draw_key(seed, "split", F.col(key))) for seed, name in zip(seeds, names)]
        return hash_marked_all(df, [*by, label], marks, n_test, [key], cells)
    out = df
    for seed, name in zip(seeds, names):
        keyed = out.withColumn("__k", draw_key(seed, "split", F.col(key)))
        out = hash_marked(keyed, [*by, label], "__k", n_test, [key], name, small_bytes).drop("__k")
    return out


def quota_per_category(df: DataFrame, category: Column, order: str, categories: Sequence[str], n: int,
                       read_cap: int | None = None, small_bytes: int | None = None) -> DataFrame:
    """First n rows of each listed category by arrival.

    Every row is read unless the caller sets a cap: then, as a stream reader
    that stops once the cap is passed, only the first cap + 1 rows are looked
    at. `quota_shortfall` tells what a cap has cost.
    """
    seen = df if read_cap is None else first_rows(df, read_cap + 1, order, small_bytes=small_bytes)
    labelled = seen.withColumn("category", category).where(F.col("category").isin(*categories))
    return first_rows(labelled, n, order, ["category"], small_bytes)


def quota_shortfall(filled: DataFrame, categories: Sequence[str], n: int) -> DataFrame:
    """(category, n_rows, shortfall) of every listed category, also of those without a row."""
    wanted = filled.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    have = filled.groupBy("category").agg(F.count(F.lit(1)).alias("__n"))
    rows = F.coalesce("__n", F.lit(0))
    return wanted.join(have, "category", "left").select("category", rows.alias("n_rows"), (F.lit(n) - rows).alias("shortfall"))
