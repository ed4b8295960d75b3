"""Quality proxies that read the data (high = good)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions import sql
from ..functions.columns import clean, numeric_columns
from .duplicates import duplicate_counts, missing_cells, outlier_rate
from .proxy import Proxy, not_applicable, single
from .shares import reference_mass, total_variation


def appropriate_amount_proxy(target_rows: int = 10_000) -> Proxy:
    return Proxy("appropriate_amount", f"n_rows / {float(max(1, target_rows))!r}D", raw_value="n_rows",
                 details={"target_rows": str(target_rows), "actual_rows": "n_rows"})


def appropriate_amount(df: DataFrame, target_rows: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    """Row count against the rows the task needs, saturating at 1."""
    return single(df, appropriate_amount_proxy(target_rows), by)


def variation_parts(df: DataFrame, reference: Mapping[str, Mapping[Any, float]], columns: Sequence[str],
                    by: Sequence[str], prefix: str) -> tuple[DataFrame, dict[str, str], str]:
    """Per-group TV of each column: the frame, its SQL cells and their mean."""
    tv = total_variation(df, {c: reference[c] for c in columns}, by)
    wide = tv.groupBy(*by).agg(*[
        F.expr(f"max(IF(column = {sql.value(c)}, tv, NULL))").alias(f"{prefix}{i}")
        for i, c in enumerate(columns)])
    # a group in which a column has no value keeps the reference's own mass
    cells = {c: f"coalesce({prefix}{i}, {reference_mass(reference, c)!r}D)" for i, c in enumerate(columns)}
    return wide, cells, f"({sql.plus(cells.values())} / {float(len(columns))!r}D)"


def representativeness_proxy(df: DataFrame, reference: Mapping[str, Mapping[Any, float]],
                             by: Sequence[str] = ()) -> Proxy:
    name = "representativeness"
    if not reference:
        return not_applicable(name, 0.5, "no reference distribution given")
    present = [c for c in reference if c in df.columns and c not in by]
    if not present:
        return Proxy(name, "0.0D", details={"reason": "'no reference column in the table'"})
    frame, cells, mean = variation_parts(df, reference, present, by, "__rep")
    return Proxy(name, f"1 - {mean}", raw_value=mean, frames=[frame],
                 details={"per_column_tv": sql.struct(cells)})


def representativeness(df: DataFrame, reference: Mapping[str, Mapping[Any, float]],
                       by: Sequence[str] = ()) -> DataFrame:
    """1 - mean total variation distance to the reference shares."""
    return single(df, representativeness_proxy(df, reference, by), by)


def free_of_error_proxy(df: DataFrame, by: Sequence[str] = (), quartiles: DataFrame | None = None,
                        small_bytes: int | None = None) -> Proxy:
    width = len(df.columns) - len(by)
    missing = f"(coalesce(__foe_missing, 0) / greatest(1, n_rows * {width}))"
    dup = "(coalesce(__foe_dup, 0) / greatest(1, n_rows))"
    frames = [duplicate_counts(df, by).withColumnRenamed("n_duplicates", "__foe_dup")]
    out = "0.0D"
    if numeric_columns(df, [c for c in df.columns if c not in by]):
        frames.append(outlier_rate(df, by, quartiles, small_bytes)
                      .withColumnRenamed("outlier_rate", "__foe_out"))
        out = "coalesce(__foe_out, 0.0D)"
    signal = f"({missing} * 0.5D + {dup} * 0.3D + {out} * 0.2D)"
    return Proxy("free_of_error", f"1 - {signal}", raw_value=signal, frames=frames,
                 aggs=[missing_cells(df, by).alias("__foe_missing")],
                 details={"missing_rate": missing, "duplicate_rate": dup, "outlier_rate": out})


def free_of_error(df: DataFrame, by: Sequence[str] = (), small_bytes: int | None = None) -> DataFrame:
    """1 - (0.5 missing + 0.3 duplicate + 0.2 outlier share)."""
    df = clean(df)
    return single(df, free_of_error_proxy(df, by, None, small_bytes), by)


def relevance_proxy(df: DataFrame, declared: Sequence[str] | None) -> Proxy:
    if not declared:
        return not_applicable("relevance", 0.5, "no declared features")
    have = set(df.columns)
    names = {"present": [c for c in declared if c in have], "missing": [c for c in declared if c not in have]}
    found = len(names["present"])
    return Proxy("relevance", f"{found / len(declared)!r}D",
                 raw_value=sql.value(f"({found}, {len(declared)})"),
                 details={k: f"array({', '.join(sql.value(c) for c in v)})" for k, v in names.items()})


def relevance(df: DataFrame, declared: Sequence[str] | None, by: Sequence[str] = ()) -> DataFrame:
    """Share of the declared features that are columns of the table."""
    return single(df, relevance_proxy(df, declared), by)
