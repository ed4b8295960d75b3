"""Do scores predict outcomes? Four tests, always per dataset, never pooled.

Each test first reduces the runs to one row per slice and checkpoints that
small table: the many branches of a test then read it instead of repeating the
aggregation of the runs. This is the one job that building a test starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import gather, no_nan
from ..functions.scalars import interpret_correlation, interpret_delta_r2
from ..operators.stats import MIN_SLICES, correlate, delta_r2, group_means, permutation_delta_r2, varies
from ..session import materialize

RIGHTS_X = ("R", "demographic_representation_gap")
RIGHTS_Y = ("eod_worst", "dpd_worst", "worst_subgroup_error_gap")
SAFETY_X = ("harm_content_density", "S_composite")
SAFETY_Y = ("mc1", "mc2")


def _finish(tests: DataFrame) -> DataFrame:
    return tests.withColumn("interpretation", interpret_correlation(
        F.col("pearson_r"), F.col("status"), F.col("n_slices"), F.col("ci_low"), F.col("ci_high")))


def quality_accuracy(metrics: DataFrame, n_boot: int = 1000, seed: int = 42,
                     small_bytes: int | None = None) -> DataFrame:
    """H1: does Q go with accuracy across the slices of a dataset?"""
    agg = materialize(group_means(metrics, ["dataset", "slice"], ["Q", "accuracy"]))
    return _finish(correlate(agg, ["dataset"], "slice", [("Q", "accuracy")], n_boot, seed, small_bytes))


def rights_fairness(metrics: DataFrame, n_boot: int = 1000, seed: int = 42,
                    small_bytes: int | None = None) -> DataFrame:
    """H2: do R and the representation gap go with the fairness gaps?

    A dataset whose R is missing in every slice gets one row with the status
    `rights_axis_not_applicable`.
    """
    agg = materialize(group_means(metrics, ["dataset", "slice"], [*RIGHTS_X, *RIGHTS_Y]))
    pairs = [(x, y) for x in RIGHTS_X if x in agg.columns for y in RIGHTS_Y if y in agg.columns]
    tests = _finish(correlate(agg.where(F.col("R").isNotNull()), ["dataset"], "slice", pairs, n_boot, seed,
                              small_bytes))
    without = (agg.groupBy("dataset").agg(F.count("R").alias("__r")).where(F.col("__r") == 0)
               .select("dataset", F.lit("rights_axis_not_applicable").alias("status")))
    return tests.unionByName(without, allowMissingColumns=True)


def safety_factuality(metrics: DataFrame, n_boot: int = 1000, seed: int = 42,
                      small_bytes: int | None = None) -> DataFrame:
    """H3: do harm density and S go with factuality, per dataset and model family?"""
    keys = ["dataset", "slice", "model_family"]
    agg = materialize(group_means(metrics, keys, [*SAFETY_X, *SAFETY_Y]))
    pairs = [(x, y) for x in SAFETY_X if x in agg.columns for y in SAFETY_Y if y in agg.columns]
    return _finish(correlate(agg, ["dataset", "model_family"], "slice", pairs, n_boot, seed, small_bytes))


def conditional_weights(metrics: DataFrame, uniform_q: DataFrame, n_perm: int = 1000, seed: int = 42,
                        small_bytes: int | None = None) -> DataFrame:
    """H4: does application-weighted Q explain accuracy better than uniform Q?"""
    agg = group_means(metrics, ["dataset", "slice"], ["Q", "accuracy"])
    both = agg.join(uniform_q.select("dataset", "slice", no_nan(F.col("q_uniform")).alias("q_uniform")),
                    ["dataset", "slice"], "left")
    both = materialize(both)
    full = both.where(F.col("Q").isNotNull() & F.col("q_uniform").isNotNull() & F.col("accuracy").isNotNull())
    size = both.groupBy("dataset").agg(F.count_if(
        F.col("Q").isNotNull() & F.col("q_uniform").isNotNull() & F.col("accuracy").isNotNull()).alias("n_slices"))
    spread = full.groupBy("dataset").agg(
        F.expr(f"{varies('Q')} AND {varies('q_uniform')}").alias("__varies"))
    point = delta_r2(full, "Q", "q_uniform", "accuracy", ["dataset"]).drop("n")
    perm = permutation_delta_r2(full, ["dataset"], "slice", "Q", "q_uniform", "accuracy", n_perm, seed, small_bytes)
    out = gather([size, spread, point, perm], ["dataset"])
    status = (F.when(F.col("n_slices") < MIN_SLICES, "underpowered")
               .when(~F.col("__varies"), "no_predictor_variance").otherwise("ok"))
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    cols = ["r2_conditional", "r2_uniform", "delta_r2", "permutation_p", "n_permutations"]
    return out.select("dataset", "status", "n_slices", *[F.when(ok, F.col(c)).alias(c) for c in cols],
                      F.when(ok, interpret_delta_r2(F.col("delta_r2"), F.col("permutation_p"))).alias("interpretation"))
