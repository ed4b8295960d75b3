"""How a proxy is described and how several are evaluated in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sql
from ..functions.columns import gather, join_on
from ..schema import AXIS, ORDER


@dataclass(frozen=True)
class Proxy:
    """A score as plain aggregates, extra per-group frames and a final expression.

    `aggs` of all proxies run in one shared scan; `frames` carry results that
    need their own shuffle. `score`, `applicable`, `raw_value` and `details`
    are SQL over the gathered one-row-per-group result.
    """

    name: str
    score: str
    applicable: str = "true"
    raw_value: str = "NULL"
    details: Mapping[str, str] = field(default_factory=dict)
    aggs: Sequence[Column] = ()
    frames: Sequence[DataFrame] = ()
    # costly inputs, computed once before they are used several times: on the
    # table's rows for `aggs`, on the gathered result for the expressions
    row_inputs: Mapping[str, Column] = field(default_factory=dict)
    inputs: Mapping[str, str] = field(default_factory=dict)

    def excluded(self, **details: str) -> "Proxy":
        """The same proxy, not applicable; its results stay visible in the details."""
        extra = {k: sql.value(v) for k, v in details.items()}
        return replace(self, applicable="false", details={**self.details, **extra})

    def struct(self) -> str:
        details = f"to_json({sql.struct(self.details)})" if self.details else "'{}'"
        return sql.struct({
            "ord": str(ORDER.get(self.name, 0)), "axis": sql.value(AXIS.get(self.name, "")),
            "name": sql.value(self.name), "score": sql.clamp01(self.score),
            "applicable": f"coalesce({self.applicable}, false)",
            "raw_value": f"CAST({self.raw_value} AS STRING)", "details": details})


def not_applicable(name: str, score: float, reason: str) -> Proxy:
    return Proxy(name, sql.value(float(score)), "false", details={"reason": sql.value(reason)})


def long_scores(wide: DataFrame, proxies: Sequence[Proxy], keys: Sequence[str]) -> DataFrame:
    """One output row per proxy for each row of `wide`."""
    cells = ", ".join(p.struct() for p in proxies)
    inputs = {k: v for p in proxies for k, v in p.inputs.items()}
    if inputs:
        wide = wide.selectExpr("*", *[f"{v} AS {k}" for k, v in inputs.items()])
    return wide.selectExpr(*[sql.name(k) for k in keys], f"inline(array({cells}))")


def evaluate(df: DataFrame, proxies: Sequence[Proxy], by: Sequence[str] = (),
             groups: DataFrame | None = None) -> DataFrame:
    """(by, n_rows, ord, axis, name, score, applicable, raw_value, details).

    `groups` lists the wanted keys, so that a slice without rows is scored too.
    """
    frames = [f for p in proxies for f in p.frames]
    aggs = [a for p in proxies for a in p.aggs]
    rows = {k: c for p in proxies for k, c in p.row_inputs.items()}
    used = df.withColumns(rows) if rows else df
    wide = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    if frames:
        wide = gather([wide, *frames], by)
    if groups is not None and by:
        wide = join_on(groups.select(*by).distinct(), wide, by, "left")
    wide = wide.withColumn("n_rows", F.expr("coalesce(n_rows, 0L)"))
    return long_scores(wide, proxies, [*by, "n_rows"])


def single(df: DataFrame, proxy: Proxy, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, applicable, raw_value, details) of one proxy."""
    return evaluate(df, [proxy], by).select(*by, "score", "applicable", "raw_value", "details")
