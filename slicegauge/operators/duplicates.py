"""Missing cells, duplicate rows and interquartile outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sql
from ..functions.columns import as_double, attach, clean, gather, numeric_columns, short_text
from .quantiles import exact_quantiles

# Distance from the quartiles, in interquartile ranges, that makes an outlier.
IQR_FACTOR = 3.0
MIN_VALUES = 4


def _data_columns(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in by]


def missing_cells(df: DataFrame, by: Sequence[str]) -> Column:
    """Aggregate: number of missing cells over all data columns."""
    cells = sql.plus(f"CAST({sql.name(c)} IS NULL AS INT)" for c in _data_columns(df, by))
    return F.expr(f"coalesce(sum(CAST({cells} AS BIGINT)), 0L)")


def missing_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, n_missing, missing_rate)."""
    df = clean(df)
    width = max(1, len(_data_columns(df, by)))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), missing_cells(df, by).alias("n_missing"))
    cells = F.greatest(F.lit(1), F.col("n_rows") * width)
    return out.withColumn("missing_rate", F.col("n_missing") / cells)


def duplicate_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_duplicates): copies beyond the first; missing values compare equal.

    Copies collapse map-side, so a row repeated a billion times is one record
    per map task in the shuffle.
    """
    df = clean(df)
    short = df.select(*by, *[short_text(df, c) for c in _data_columns(df, by)])
    same = short.groupBy(*short.columns).agg(F.count(F.lit(1)).alias("__n"))
    return same.groupBy(*by).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"))


def duplicate_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, n_duplicates, duplicate_rate)."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    both = gather([size, duplicate_counts(df, by)], by)
    dup = F.coalesce("n_duplicates", F.lit(0))
    return both.select(*by, "n_rows", dup.alias("n_duplicates"),
                       (dup / F.greatest(F.lit(1), F.col("n_rows"))).alias("duplicate_rate"))


def outlier_shares(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                   quartiles: DataFrame | None = None, small_bytes: int | None = None) -> DataFrame:
    """(by, column, n, lo, hi, n_out, share): values beyond 3 IQR of the quartiles.

    Columns with fewer than four values or no interquartile range are left
    out. `quartiles` is a (by, column, n, q) frame with q = [Q1, Q3].
    """
    df = clean(df)
    cols = numeric_columns(df, columns or _data_columns(df, by))
    if quartiles is None:
        quartiles = exact_quantiles(df, cols, [0.25, 0.75], by, small_bytes)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bounds = (quartiles.where((F.col("n") >= MIN_VALUES) & (q3 - q1 != 0) & F.col("column").isin(*cols))
              .select(*by, "column", "n", (q1 - IQR_FACTOR * (q3 - q1)).alias("lo"),
                      (q3 + IQR_FACTOR * (q3 - q1)).alias("hi")))
    # bounds of all columns on one row per group, then a single pass over the table
    wide = bounds.groupBy(*by).agg(*[
        F.first(F.when(F.col("column") == c, F.struct("n", "lo", "hi")), ignorenulls=True).alias(f"__b{i}")
        for i, c in enumerate(cols)])
    both = attach(df, wide, by)
    bound = {c: F.col(f"__b{i}") for i, c in enumerate(cols)}
    outs = []
    for i, c in enumerate(cols):
        v, b = as_double(df, c), bound[c]
        outs.append(F.count_if((v < b["lo"]) | (v > b["hi"])).alias(f"__o{i}"))
    counted = both.groupBy(*by).agg(*outs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__o{i}").alias("n_out"))
                      for i, c in enumerate(cols)])
    long = counted.select(*by, F.inline(cells))
    return (gather([bounds, long], [*by, "column"]).where(F.col("n").isNotNull())
            .select(*by, "column", "n", "lo", "hi", "n_out", (F.col("n_out") / F.col("n")).alias("share")))


def outlier_rate(df: DataFrame, by: Sequence[str] = (), quartiles: DataFrame | None = None,
                 small_bytes: int | None = None) -> DataFrame:
    """(by, outlier_rate): mean share over the usable numeric columns; no row if none."""
    shares = outlier_shares(df, by, None, quartiles, small_bytes)
    return shares.groupBy(*by).agg(F.avg("share").alias("outlier_rate"))
