"""Row-wise derivations used by the table preparation steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def at_least(c: Column, threshold: float) -> Column:
    """1 when the value reaches the threshold; missing counts as 0."""
    return F.coalesce((c >= F.lit(threshold)).cast("int"), F.lit(0))


def equals(c: Column, value: Any) -> Column:
    return F.coalesce((c == F.lit(value)).cast("int"), F.lit(0))


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def code_table(groups: Mapping[str, Sequence[Any]]) -> dict[Any, str]:
    """Code -> label; a code listed twice belongs to the later label."""
    return {code: label for label, codes in groups.items() for code in codes}


def code_label(c: Column, groups: Mapping[str, Sequence[Any]], default: str | None = "other") -> Column:
    """Map codes to labels; unlisted and missing codes take the default."""
    by_label: dict[str, list[Any]] = {}
    for code, label in code_table(groups).items():
        by_label.setdefault(label, []).append(code)
    out = None
    for label, codes in by_label.items():
        cond = c.isin(*codes)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def interval_label(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals (e0, e1], (e1, e2], ...; outside is NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    out = F.when(c <= F.lit(edges[0]), F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(hi), F.lit(label))
    return out


def with_age(df: DataFrame, anchor_age: str, year: str, anchor_year: str, name: str = "age") -> DataFrame:
    """Age at an event from an anchor age and year, if the inputs exist."""
    if not {anchor_age, year, anchor_year} <= set(df.columns):
        return df
    return df.withColumn(name, F.col(anchor_age) + (F.col(year) - F.col(anchor_year)))


def filled_int(c: Column, value: int = 0) -> Column:
    return F.coalesce(c, F.lit(value)).cast("int")


def blank_tokens(df: DataFrame, tokens: Sequence[str], trim: bool = True) -> DataFrame:
    """Several spellings of 'missing' in string columns become NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() == "string":
            t = F.trim(c) if trim else c
            c = F.when(~t.isin(*tokens), t).alias(f.name)
        out.append(c)
    return df.select(*out)


def interpret_correlation(r: Column, status: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Short reading of a correlation and its interval."""
    size = F.abs(r)
    strength = F.when(size < 0.3, "weak").when(size < 0.6, "moderate").otherwise("strong")
    sign = F.when(r > 0, "positive").otherwise("negative")
    sig = F.when((lo > 0) | (hi < 0), "CI excludes zero").otherwise("CI crosses zero (inconclusive)")
    return (F.when(status != "ok", F.format_string("%s (n_slices=%d)", status, n))
             .when(r.isNull() | F.isnan(r), "no variance / undefined")
             .otherwise(F.format_string("%s %s (r=%.2f); %s", strength, sign, r, sig)))


def interpret_delta_r2(delta: Column, p: Column) -> Column:
    side = F.when(delta > 0, "conditional > uniform").otherwise("uniform > conditional")
    sig = (F.when(p < 0.05, "statistically significant (p<.05)")
            .otherwise("not statistically significant"))
    return (F.when(delta.isNull() | F.isnan(delta), "undefined")
             .otherwise(F.format_string("%s (ΔR²=%+.3f); %s", side, delta, sig)))
