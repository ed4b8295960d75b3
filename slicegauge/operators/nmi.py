"""Normalized mutual information of all (feature, protected) pairs in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import sql
from ..functions.columns import as_double, attach, gather, numeric_columns, short_text
from .quantiles import exact_quantiles

DECILES = [i / 10 for i in range(11)]


def bin_edges(quantiles: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group: per numeric column the inner edges of its right-closed bins.

    Repeated edges make no bin of their own. NULL where an infinite value
    leaves no intervals: the values then are the categories.
    """
    infinite = "abs(q[0]) = double('inf') OR abs(element_at(q, -1)) = double('inf')"
    inner = "array_distinct(filter(slice(q, 2, size(q) - 2), e -> e > q[0]))"
    clean = quantiles.select(*by, "column", F.expr(f"IF({infinite}, NULL, {inner})").alias("__edges"))
    return clean.groupBy(*by).agg(*[
        F.expr(f"first(IF(column = {sql.value(c)}, __edges, NULL), true)").alias(f"__e{i}")
        for i, c in enumerate(columns)])


def _label(value: str, edges: str, n_bins: int) -> str:
    """SQL: category of a number, the count of inner edges below it.

    Unrolled rather than a lambda over the edges, which would leave codegen.
    """
    below = sql.plus(f"IF({value} > get({edges}, {i}), 1, 0)" for i in range(n_bins - 1))
    return f"IF({edges} IS NULL, CAST({value} AS STRING), CAST({below} AS STRING))"


def nmi_pairs(df: DataFrame, features: Sequence[str], protected: Sequence[str], by: Sequence[str] = (),
              n_bins: int = 10, quantiles: DataFrame | None = None,
              small_bytes: int | None = None) -> DataFrame:
    """(by, feature, protected, n, mi, h_x, h_y, nmi) over rows where both sides are present.

    Numeric columns fall into quantile bins of their group, all else is taken
    as text. Rows are unpivoted over the features only; the protected labels
    stay columns, so the map-side counts do most of the work and the second
    unpivot runs over counts. NMI = 2 MI / (H(x) + H(y)), natural logarithm.
    """
    by = list(by)
    cols = list(dict.fromkeys([*features, *protected]))
    nums = numeric_columns(df, cols, with_bool=True)
    if nums:
        if quantiles is None:
            quantiles = exact_quantiles(df, nums, [i / n_bins for i in range(n_bins + 1)], by, small_bytes)
        df = attach(df, bin_edges(quantiles, nums, by), by, "left")
    number = {c: as_double(df, c) for c in nums}
    edge = {c: F.col(f"__e{i}") for i, c in enumerate(nums)}
    no_edges = F.lit(None).cast("array<double>")
    names = [f"__p{i}" for i in range(len(protected))]
    df = df.withColumns({f"__n{i}": number[p] for i, p in enumerate(protected) if p in nums})
    prot = [F.expr(_label(f"__n{i}", f"__e{nums.index(p)}", n_bins)).alias(n) if p in nums else short_text(df, p).cast("string").alias(n)
            for i, (p, n) in enumerate(zip(protected, names))]
    # one label expression for all features: it runs after the unpivot
    cells = F.array(*[F.struct(
        F.lit(f).alias("feature"), number.get(f, F.lit(None).cast("double")).alias("__v"),
        (F.lit(None) if f in nums else short_text(df, f)).cast("string").alias("__s"),
        edge.get(f, no_edges).alias("__edges")) for f in features])
    long = df.select(*by, *prot, F.inline(cells)).where("__v IS NOT NULL OR __s IS NOT NULL")
    x = F.expr(f"IF(__v IS NULL, __s, {_label('__v', '__edges', n_bins)})").alias("__x")
    first = long.select(*by, *names, "feature", x).groupBy(*by, "feature", "__x", *names).agg(
        F.count(F.lit(1)).alias("__c"))
    sides = F.array(*[F.struct(F.lit(p).alias("protected"), F.col(n).alias("__y"))
                      for p, n in zip(protected, names)])
    joint = (first.select(*by, "feature", "__x", "__c", F.inline(sides)).where(F.col("__y").isNotNull())
             .groupBy(*by, "feature", "protected", "__x", "__y").agg(F.sum("__c").alias("__c")))
    g = [*by, "feature", "protected"]
    # sum(c ln c) of the joint counts and of both margins determine MI and entropies
    weight = F.expr("sum(__c * ln(__c))")
    s_xy = joint.groupBy(*g).agg(F.sum("__c").alias("n"), weight.alias("__sxy"))
    s_x = (joint.groupBy(*g, "__x").agg(F.sum("__c").alias("__c"))
           .groupBy(*g).agg(weight.alias("__sx"), F.count(F.lit(1)).alias("__kx")))
    s_y = (joint.groupBy(*g, "__y").agg(F.sum("__c").alias("__c"))
           .groupBy(*g).agg(weight.alias("__sy"), F.count(F.lit(1)).alias("__ky")))
    # a single category has entropy zero exactly, whatever the rounding
    return gather([s_xy, s_x, s_y], g).selectExpr(
        *[sql.name(k) for k in g], "n",
        "IF(__kx = 1 OR __ky = 1, 0.0D, ln(n) + (__sxy - __sx - __sy) / n) AS mi",
        "IF(__kx = 1, 0.0D, ln(n) - __sx / n) AS h_x", "IF(__ky = 1, 0.0D, ln(n) - __sy / n) AS h_y",
    ).selectExpr("*", "coalesce(try_divide(2 * mi, h_x + h_y), 0.0D) AS nmi")


def feature_max(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, max_nmi, protected): the strongest protected partner per feature."""
    return pairs.groupBy(*by, "feature").agg(
        F.max("nmi").alias("max_nmi"),
        F.min_by("protected", F.struct(-F.col("nmi"), F.col("protected"))).alias("protected"))
