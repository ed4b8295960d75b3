"""Which stored scores no longer describe their table: our own rule, from the distance of Q2 and the age of Q7.

A score is stored with a snapshot of the value counts it was taken from. Later
the same counts of the table as it is now are set against them, so neither
table is compared row by row and the old rows need not exist any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import dates
from ..functions.columns import as_double, attach, melt, short_text


def share_snapshot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value, n): value counts, missing values left out; store it with the scores.

    Numbers stand as text of their double, so that a column whose type is
    widened later still meets its old values; long texts stand as digests.
    """
    def key(c):
        kind = df.schema[c].dataType
        return (as_double(df, c) + F.lit(0.0) if isinstance(kind, (T.NumericType, T.BooleanType)) else short_text(df, c)).cast("string")

    long = melt(df, by, {c: key(c) for c in columns}).where(F.col("value").isNotNull())
    return long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def share_drift(then: DataFrame, now: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n_then, n_now, drift): total variation distance of two snapshots.

    A group or column that only one of them has is as far off as can be: 1.
    """
    g = [*by, "column"]
    zero = F.lit(0).cast("bigint")
    both = (then.select(*g, "value", F.col("n").alias("__a"), zero.alias("__b"))
            .unionByName(now.select(*g, "value", zero.alias("__a"), F.col("n").alias("__b"))))
    pairs = both.groupBy(*g, "value").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    totals = pairs.groupBy(*g).agg(F.sum("__a").alias("n_then"), F.sum("__b").alias("n_now"))
    gap = F.abs(F.try_divide("__a", "n_then") - F.try_divide("__b", "n_now"))
    out = attach(pairs, totals, g).groupBy(*g, "n_then", "n_now").agg((F.sum(gap) / 2).alias("drift"))
    return out.withColumn("drift", F.coalesce("drift", F.lit(1.0)))


def stale_scores(then: DataFrame, now: DataFrame, dated: DataFrame, as_of: str, by: Sequence[str] = (),
                 max_drift: float = 0.1, max_fade: float = 0.25, half_life_days: float = 365.0) -> DataFrame:
    """(by, column, n_then, n_now, drift, timeliness_then, timeliness_now, reason, stale) of stored scores.

    `dated` has a row per group with the timestamps `updated` (of the data) and
    `scored_at`. A score is stale if a column's shares have drifted by more than
    `max_drift`, or if timeliness has faded by more than `max_fade` between
    `scored_at` and `as_of`. Without dates only drift can tell.
    """
    age = "greatest(0.0D, (unix_micros(scored_at) - unix_micros(updated)) / 86400e6D)"
    then_days = f"CASE WHEN updated IS NOT NULL AND scored_at IS NOT NULL THEN {age} END"
    fresh = dated.select(*by, F.expr(dates.decay(then_days, half_life_days)).alias("timeliness_then"),
                         F.expr(dates.decay(dates.age_days("updated", as_of), half_life_days)).alias("timeliness_now"))
    out = attach(share_drift(then, now, by), fresh, by, "left")
    drifted, faded = F.col("drift") > max_drift, F.col("timeliness_then") - F.col("timeliness_now") > max_fade
    reason = F.nullif(F.concat_ws(",", F.when(drifted, "drift"), F.when(faded, "age")), F.lit(""))
    return out.withColumn("reason", reason).withColumn("stale", F.col("reason").isNotNull())
