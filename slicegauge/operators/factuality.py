"""Multiple-choice factuality from a table of per-choice log-likelihoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import join_on


def explode_choices(benchmark: DataFrame, kind: str, question: str = "question") -> DataFrame:
    """(question, idx, choice, label) from the list columns `<kind>_choices/_labels`."""
    both = F.arrays_zip(F.col(f"{kind}_choices").alias("choice"), F.col(f"{kind}_labels").alias("label"))
    return (benchmark.select(question, F.posexplode(both).alias("idx", "__c"))
            .select(question, "idx", F.col("__c.choice").alias("choice"), F.col("__c.label").alias("label")))


def mc1(choices: DataFrame, question: str, by: Sequence[str] = (), idx: str = "idx", ll: str = "ll",
        label: str = "label") -> DataFrame:
    """(by, mc1, n_questions): share of questions whose likeliest choice is the labelled one.

    Ties go to the first choice. `min_by` is combined map-side, so a question
    with very many choices is no burden.
    """
    top = F.min_by(idx, F.struct(-F.col(ll), F.col(idx)))
    right = F.min_by(idx, F.struct(-F.col(label), F.col(idx)))
    per = choices.groupBy(*by, question).agg((top == right).cast("int").alias("__ok"))
    return per.groupBy(*by).agg(F.avg("__ok").alias("mc1"), F.count(F.lit(1)).alias("n_questions"))


def mc2(choices: DataFrame, question: str, by: Sequence[str] = (), ll: str = "ll",
        label: str = "label") -> DataFrame:
    """(by, mc2, n_questions): mean softmax mass on the choices labelled true.

    The shift by the question's maximum is looked up, not windowed, and the
    two sums are combined map-side.
    """
    keys = [*by, question]
    top = choices.groupBy(*keys).agg(F.max(ll).alias("__max"))
    e = F.exp(F.col(ll) - F.col("__max"))
    per = join_on(choices, top, keys).groupBy(*keys).agg((F.sum(e * F.col(label)) / F.sum(e)).alias("__p"))
    return per.groupBy(*by).agg(F.avg("__p").alias("mc2"), F.count(F.lit(1)).alias("n_questions"))
