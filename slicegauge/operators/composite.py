"""Composite scores, gates and table shapes built from the long score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sql
from ..schema import APPLICATIONS, PROXIES, QUALITY, QUALITY_WEIGHTS, RIGHTS, SAFETY


def weight_of(application: str | None = None) -> str:
    """SQL: quality weight of the row's proxy `name`; the row's own `application` if none is named."""
    table = {a: sql.choose("name", QUALITY_WEIGHTS[a], "1.0D") for a in APPLICATIONS}
    if application is not None:
        return table[application]
    arms = " ".join(f"WHEN {sql.value(a)} THEN {w}" for a, w in table.items())
    return f"CASE application {arms} END"


def composites(scores: DataFrame, application: str | None = "ML", by: Sequence[str] = ()) -> DataFrame:
    """(by, quality, safety, rights, excluded_for_na, breakdown) of a long score table.

    Quality is the weighted mean over the applicable rows, 0.0 without any;
    safety and rights are plain means, NULL without any. With `application`
    None each row carries its own in a column, which must be among `by`.
    """
    if application is not None and application not in APPLICATIONS:
        raise ValueError(f"unknown application {application!r}; known: {', '.join(APPLICATIONS)}")
    weighed = scores.withColumn("__w", F.expr(f"IF(applicable AND axis = '{QUALITY}', {weight_of(application)}, NULL)"))
    mean = "avg(IF(applicable AND axis = '{}', score, NULL))"
    # at most one entry per proxy and group
    return weighed.groupBy(*by).agg(
        F.expr("coalesce(try_divide(sum(__w * score), sum(__w)), 0.0D)").alias("quality"),
        F.expr(mean.format(SAFETY)).alias("safety"), F.expr(mean.format(RIGHTS)).alias("rights"),
        F.expr("transform(array_sort(collect_list(IF(applicable, NULL, struct(ord, name)))), x -> x.name)")
        .alias("excluded_for_na"),
        F.expr("array_sort(collect_list(struct(ord, axis, name, IF(applicable, score, NULL) AS score, applicable)))")
        .alias("breakdown"))


def passes_threshold(q_min: float = 0.7, s_max: float = 0.2, r_max: float = 0.2,
                     quality: str = "quality", safety: str = "safety", rights: str = "rights") -> Column:
    """Gate on the three composites; an axis that does not apply passes."""
    return ((F.col(quality) >= q_min) & F.coalesce(F.col(safety) <= s_max, F.lit(True))
            & F.coalesce(F.col(rights) <= r_max, F.lit(True)))


def uniform_quality(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, q_uniform): plain mean of the applicable quality scores."""
    return scores.where(F.col("axis") == QUALITY).groupBy(*by).agg(
        F.avg(F.when(F.col("applicable"), F.col("score"))).alias("q_uniform"))


def by_application(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The composites under each application; scores are computed once."""
    apps = F.explode(F.array(*[F.lit(a) for a in APPLICATIONS]))
    return composites(scores.withColumn("application", apps), None, [*by, "application"])


def scores_wide(scores: DataFrame, by: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per group, one column per proxy; NULL where it does not apply."""
    names = list(names or [n for _, n in PROXIES])
    return scores.groupBy(*by).agg(*[
        F.max(F.when((F.col("name") == n) & F.col("applicable"), F.col("score"))).alias(n) for n in names])


def slice_grid(summary: DataFrame, dataset: str, slice_: str, value: str) -> DataFrame:
    """(dataset, idx, value): every slice of a dataset at its place, from 0, in slice order.

    The cells of the grid in long form, as wide as the longest dataset.
    `summary` has one row per slice, so the window sees only slice names.
    """
    w = Window.partitionBy(dataset).orderBy(slice_)
    return summary.select(dataset, (F.row_number().over(w) - 1).alias("idx"), value)
