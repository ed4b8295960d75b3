"""Value shares, total variation distance, entropy and group sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import sql
from ..functions.columns import FLOATS, as_double, attach, melt, short_text


# A reference with more values than this is joined as Spark sees fit.
BROADCAST_ROWS = 100_000


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, share): normalized counts, missing values left out."""
    c = as_double(df, column) if isinstance(df.schema[column].dataType, FLOATS) else F.col(column)
    counts = (df.select(*by, c.alias("value")).where(F.col("value").isNotNull())
              .groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    return attach(counts, total, by).select(*by, "value", "n", (F.col("n") / F.col("__total")).alias("share"))


def _as_key(df: DataFrame, column: str) -> Column:
    """Text form of a value under which 1, 1.0 and True meet their reference key."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return as_double(df, column).cast("string")
    return F.col(column).cast("string")


def _reference_table(df: DataFrame, reference: Mapping[str, Mapping[Any, float]]) -> DataFrame:
    """(column, value, p) from a caller's dictionary; its keys typed like the column."""
    rows = []
    for col, probs in reference.items():
        numeric = isinstance(df.schema[col].dataType, (T.NumericType, T.BooleanType))
        for k, p in probs.items():
            rows.append((col, None if numeric else str(k), float(k) if numeric else None, float(p)))
    out = sql.local_table(df.sparkSession, rows, ["column", "s", "d", "p"])
    text = F.coalesce(F.col("s").cast("string"), F.col("d").cast("double").cast("string"))
    return out.select("column", text.alias("value"), "p")


def total_variation(df: DataFrame, reference: Mapping[str, Mapping[Any, float]],
                    by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, tv): half the L1 gap between shares and reference.

    Only values named in the reference matter one by one, all others as a sum.
    They are told apart before counting, so the shuffle holds at most
    (reference values + 1) rows per group and map task whatever the column's
    cardinality. The reference is a caller's dictionary, broadcast up to a
    checked number of values.
    """
    ref = {c: dict(p) for c, p in reference.items() if c in df.columns and p}
    empty = [c for c, p in reference.items() if c in df.columns and not p]
    if not ref and not empty:
        raise ValueError("no reference column is in the table")
    cells = {c: _as_key(df, c) for c in [*ref, *empty]}
    long = melt(df, by, cells).where(F.col("value").isNotNull())
    if ref:
        table = _reference_table(df, ref)
        if sum(len(p) for p in ref.values()) <= BROADCAST_ROWS:
            table = F.broadcast(table)
        long = long.join(table, ["column", "value"], "left")
    else:
        long = long.withColumn("p", F.lit(None).cast("double"))
    counts = (long.withColumn("value", F.when(F.col("p").isNotNull(), F.col("value")))
              .groupBy(*by, "column", "value", "p").agg(F.count(F.lit(1)).alias("__c")))
    seen = counts.groupBy(*by, "column").agg(
        F.sum("__c").alias("n"),
        F.sum(F.when(F.col("p").isNull(), F.col("__c")).otherwise(0)).alias("__other"),
        F.sum(F.coalesce(F.abs("p"), F.lit(0.0))).alias("__p_seen"),
        # entries are bounded by the caller's dictionary
        F.collect_list(F.when(F.col("p").isNotNull(), F.struct(F.col("__c").alias("c"), "p"))).alias("__hits"))
    mass = sql.choose("column", {c: float(sum(abs(p) for p in ps.values())) for c, ps in ref.items()}, "0.0D")
    gaps = "aggregate(__hits, 0.0D, (acc, h) -> acc + abs(h.p - h.c / n))"
    tv = F.expr(f"0.5D * ({gaps} + __other / n + {mass} - __p_seen)")
    return seen.select(*by, "column", "n", tv.alias("tv"))


def reference_mass(reference: Mapping[str, Mapping[Any, float]], column: str) -> float:
    """TV of a column without any value: half of the reference's own mass."""
    return 0.5 * sum(abs(float(p)) for p in reference[column].values())


def class_sizes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, n_classes): smallest and number of value combinations; NULL is a value."""
    short = df.select(*by, *[short_text(df, c) for c in columns])
    sizes = short.groupBy(*short.columns).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.groupBy(*by).agg(F.min("__n").alias("k"), F.count(F.lit(1)).alias("n_classes"))


def entropy(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, entropy) in nats over the non-missing values.

    H = ln N - sum(c ln c) / N, so the counts need no second pass for shares.
    """
    long = melt(df, by, {c: _as_key(df, c) for c in columns}).where(F.col("value").isNotNull())
    counts = long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("__c"))
    n = F.sum("__c")
    h = F.ln(n) - F.sum(F.col("__c") * F.ln("__c")) / n
    return counts.groupBy(*by, "column").agg(n.alias("n"), F.greatest(F.lit(0.0), h).alias("entropy"))
