"""Small helpers for expressions written as Spark SQL text.

Row-wise formulas over one-row-per-slice results are plain SQL: one parser
call instead of a Python call per operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def value(v: Any) -> str:
    """A Python scalar as an SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def choose(subject: str, table: Mapping[Any, Any], default: str) -> str:
    """CASE over equality with the keys of a table."""
    if not table:
        return default
    arms = " ".join(f"WHEN {value(k)} THEN {value(v)}" for k, v in table.items())
    return f"CASE {subject} {arms} ELSE {default} END"


def plus(terms: Iterable[str], empty: str = "0") -> str:
    terms = [f"({t})" for t in terms]
    return "(" + " + ".join(terms) + ")" if terms else empty


def clamp01(x: str) -> str:
    """Into [0, 1]; NaN and NULL become 0. Adding 0.0 drops a negative zero."""
    return f"(greatest(0.0D, least(1.0D, coalesce(nanvl(CAST({x} AS DOUBLE), 0.0D), 0.0D))) + 0.0D)"


def struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{value(k)}, {v}" for k, v in fields.items()) + ")"


def local_table(spark: SparkSession, rows: Sequence[Sequence[Any]], columns: Sequence[str]) -> DataFrame:
    """A caller's few rows as a local relation: no Python worker, size known to Catalyst."""
    values = ", ".join("(" + ", ".join(value(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(name(c) for c in columns)})")
