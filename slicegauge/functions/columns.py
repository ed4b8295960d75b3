"""Null handling, clamping, type splits and null-safe joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import sql
from ..session import is_small, materialize

FLOATS = (T.FloatType, T.DoubleType)
# Texts up to this length are compared as they are, longer ones by digest.
KEPT_BYTES = 64


def no_nan(c: Column) -> Column:
    """NaN and NULL are one kind of missing value."""
    return F.when(~F.isnan(c), c)


def clean(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column; other columns pass through."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)}
    if not floats:
        return df
    return df.select(*[no_nan(F.col(c)).alias(c) if c in floats else F.col(c)
                       for c in df.columns])


def numeric_columns(df: DataFrame, among: Iterable[str] | None = None,
                    with_bool: bool = False) -> list[str]:
    """Numeric columns by declared type, in table order."""
    pick = set(df.columns if among is None else among)
    kinds = (T.NumericType, T.BooleanType) if with_bool else (T.NumericType,)
    return [f.name for f in df.schema.fields if f.name in pick and isinstance(f.dataType, kinds)]


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric or boolean column as double, missing as NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    c = F.col(name).cast("double")
    return no_nan(c) if isinstance(kind, FLOATS) else c


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select the listed columns that exist, in the listed order."""
    return df.select(*[n for n in names if n in df.columns])


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def short_text(df: DataFrame, column: str) -> Column:
    """A column whose values only need telling apart: a long text stands as its SHA-256, so that whole texts are not shuffled.

    The stand-in is longer than any text that is kept as it is, so the two
    never meet.
    """
    c = sql.name(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return F.col(column)
    return F.expr(f"IF(octet_length({c}) <= {KEPT_BYTES}, {c}, concat('sha2-256:', sha2({c}, 256)))").alias(column)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; keeps the left keys.

    No hint is set: Spark broadcasts the right side only below its own size
    threshold and otherwise shuffles, with the adaptive skew split on top.
    """
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach(df: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Add a one-row-per-group result to the rows of the groups.

    Without group keys the single row is a scalar subquery, not a join. For
    rows beyond the small size the result is written first: Spark then knows
    how small it is and broadcasts it, where it would otherwise shuffle and
    sort the rows by group before it knows, a whole group in one task.
    """
    if by:
        return join_on(df, right if is_small(df) else materialize(right), by, how)
    one = right.select(F.struct(*right.columns)).scalar()
    return df.select("*", one.alias("__one")).select(*df.columns, "__one.*")


def melt(df: DataFrame, keep: Sequence[str | Column], values: dict[str, Column],
         name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long in one projection: one output row per (row, entry of `values`)."""
    cells = [F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()]
    keep_cols = [F.col(k) if isinstance(k, str) else k for k in keep]
    return df.select(*keep_cols, F.inline(F.array(*cells)))


def gather(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Put per-group results with different columns side by side.

    Union then one grouped `first`: a single small shuffle however many parts,
    NULL group keys stay a group, and no join is needed when `by` is empty.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in by]
    return out.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
