"""Accuracy and fairness gaps of predictions by protected group.

Input: y_true, y_pred and `prot__<attribute>` columns plus any run keys. The
rows are read once; everything works on the counts per (run, attribute, group),
which are combined map-side and therefore do not care how large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import FLOATS, join_on, no_nan

PREFIX = "prot__"


def _correct() -> Column:
    return (F.col("y_true") == F.col("y_pred")).cast("int")


def overall_accuracy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_test, accuracy)."""
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.avg(_correct()).alias("accuracy"))


def _cells(pred: DataFrame, protected: Sequence[str]) -> list[Column]:
    """One (attr_ord, attribute, present, group) per attribute, whether the data has its column or not."""
    cells = []
    for i, p in enumerate(protected):
        present = PREFIX + p in pred.columns
        c = F.col(PREFIX + p) if present else F.lit(None)
        if present and isinstance(pred.schema[PREFIX + p].dataType, FLOATS):
            c = no_nan(c)
        cells.append(_cell(i, p, present, c))
    return cells


def _cell(i: int, name: str | None, present: bool, group: Column) -> Column:
    return F.struct(F.lit(i).alias("attr_ord"), F.lit(name).cast("string").alias("attribute"),
                    F.lit(present).alias("present"), group.cast("string").alias("group"))


def _grouped(pred: DataFrame, cells: list[Column], by: Sequence[str]) -> DataFrame:
    """Counts and rates per (by, cell): the one pass over the predictions."""
    none = "array<struct<attr_ord:int,attribute:string,present:boolean,group:string>>"
    array = F.array(*cells) if cells else F.array().cast(none)
    hit, yes, pos = (F.col("y_pred") == 1).cast("int"), F.col("y_true") == 1, F.col("y_true") == 0
    long = pred.select(*by, _correct().alias("ok"), hit.alias("hit"), yes.alias("yes"), pos.alias("no"), F.inline(array))
    real = lambda c: F.when(F.col("present"), c)
    return long.groupBy(*by, "attr_ord", "attribute", "present", "group").agg(
        F.count(real(F.lit(1))).alias("n"), F.avg(real(F.col("ok"))).alias("accuracy"), F.avg(real(1 - F.col("ok"))).alias("error"),
        F.avg(real(F.col("hit"))).alias("positive_rate"),
        F.avg(real(F.when(F.col("yes"), F.col("hit")))).alias("tpr"),
        F.avg(real(F.when(F.col("no"), F.col("hit")))).alias("fpr"))


def subgroups(pred: DataFrame, protected: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, attr_ord, attribute, present, group, n, accuracy, error, positive_rate, tpr, fpr).

    A missing attribute value is a group of its own (NULL here). An attribute
    without a column is one row per run with present = false, n = 0 and NULLs;
    without any attribute there are no rows.
    """
    return _grouped(pred, _cells(pred, protected), by)


def subgroup_accuracy(pred: DataFrame, protected: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, attribute, group, n, accuracy); a missing value is the group 'nan', an absent attribute a NULL row."""
    group = F.when(F.col("present"), F.coalesce("group", F.lit("nan")))
    return subgroups(pred, protected, by).select(*by, "attribute", group.alias("group"), "n", "accuracy")


def _lowest() -> Column:
    """First of equal minima: attribute order, then group order, missing last."""
    return F.min(F.when(F.col("n") > 0, F.struct(
        F.col("accuracy"), F.col("attr_ord"), F.col("group").isNull().alias("gone"), F.col("group"), F.col("attribute"))))


def _worst(low: str) -> list[Column]:
    c = F.col(low)
    return [c["accuracy"].alias("worst_subgroup_accuracy"), c["attribute"].alias("worst_subgroup_attr"),
            F.when(c.isNotNull(), F.coalesce(c["group"], F.lit("nan"))).alias("worst_subgroup_group")]


def worst_subgroup(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, worst accuracy, its attribute and group) from a `subgroups` result; NULLs if no attribute has a column."""
    return groups.groupBy(*by).agg(_lowest().alias("__low")).select(*by, *_worst("__low"))


def _gap_columns() -> list[Column]:
    both = F.col("tpr").isNotNull() & F.col("fpr").isNotNull()
    tpr, fpr = F.when(both, F.col("tpr")), F.when(both, F.col("fpr"))
    eod = F.greatest(F.max(tpr) - F.min(tpr), F.max(fpr) - F.min(fpr))
    n = F.count_if(F.col("present"))
    return [n.alias("n_groups"), F.when(n >= 2, F.max("positive_rate") - F.min("positive_rate")).alias("dpd"),
            F.when(F.count_if(both) >= 2, eod).alias("eod")]


def attribute_gaps(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, attr_ord, attribute, n_groups, dpd, eod) from a `subgroups` result.

    The largest pairwise difference is max - min. Equalized odds looks only at
    groups in which both rates exist; fewer than two leave it NULL. An absent
    attribute has 0 groups and NULLs.
    """
    return groups.groupBy(*by, "attr_ord", "attribute").agg(*_gap_columns())


def demographic_parity_difference(pred: DataFrame, protected: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return attribute_gaps(subgroups(pred, protected, by), by).select(*by, "attribute", "n_groups", "dpd")


def equalized_odds_difference(pred: DataFrame, protected: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return attribute_gaps(subgroups(pred, protected, by), by).select(*by, "attribute", "n_groups", "eod")


def subgroup_error_gap(pred: DataFrame, protected: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, worst_subgroup_error_gap) over the groups of all attributes together."""
    return subgroups(pred, protected, by).groupBy(*by).agg(
        (F.max("error") - F.min("error")).alias("worst_subgroup_error_gap"))


OVERALL = -1


def _rolled_up(pred: DataFrame, protected: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Everything per run from one chain of aggregations, each over the rows of the one before.

    All rows of a run together are a group of an attribute of their own, so
    accuracy needs no second pass and runs without attributes keep it.
    """
    groups = _grouped(pred, [_cell(OVERALL, None, True, F.lit(None)), *_cells(pred, protected)], by)
    per = groups.groupBy(*by, "attr_ord", "attribute").agg(
        *_gap_columns(), _lowest().alias("low"), F.max("error").alias("high_error"), F.min("error").alias("low_error"),
        F.max("n").alias("n_test"), F.max("accuracy").alias("accuracy"))
    whole, part = F.col("attr_ord") == OVERALL, F.col("attr_ord") != OVERALL
    return per.groupBy(*by).agg(
        F.max(F.when(whole, F.col("n_test"))).alias("n_test"), F.max(F.when(whole, F.col("accuracy"))).alias("accuracy"),
        F.min(F.when(part, F.col("low"))).alias("__low"), F.max(F.when(part, F.col("dpd"))).alias("dpd_worst"),
        F.max(F.when(part, F.col("eod"))).alias("eod_worst"),
        (F.max(F.when(part, F.col("high_error"))) - F.min(F.when(part, F.col("low_error")))).alias("worst_subgroup_error_gap"))


def fairness_summary(pred: DataFrame, protected: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, dpd_worst, eod_worst, worst_subgroup_error_gap): worst over the attributes; NULLs without any."""
    return _rolled_up(pred, protected, by).select(*by, "dpd_worst", "eod_worst", "worst_subgroup_error_gap")


def run_metrics(pred: DataFrame, protected: Sequence[str],
                by: Sequence[str] = ("slice", "model_family", "seed")) -> DataFrame:
    """All accuracy and fairness columns, one row per run, from one scan of the predictions."""
    return _rolled_up(pred, protected, by).select(
        *by, "n_test", "accuracy", *_worst("__low"), "dpd_worst", "eod_worst", "worst_subgroup_error_gap")


SCORE_COLUMNS = ("Q", "S", "R", "demographic_representation_gap", "harm_content_density", "application")


def scores_for_metrics(scores: DataFrame, application: str, keys: Sequence[str] = ("dataset", "slice")) -> DataFrame:
    """(keys, Q, S, R, two sub-scores, application) of long scores, as `with_scores` joins them to metrics."""
    from .composite import composites, scores_wide
    comp = composites(scores, application, list(keys)).select(*keys, F.col("quality").alias("Q"), F.col("safety").alias("S"), F.col("rights").alias("R"))
    wide = scores_wide(scores, keys, ["demographic_representation_gap", "harm_content_density"])
    return join_on(comp, wide, list(keys), "left").withColumn("application", F.lit(application))


def with_scores(metrics: DataFrame, scores: DataFrame, keys: Sequence[str] = ("dataset", "slice")) -> DataFrame:
    """Score columns looked up by slice; a slice without scores keeps NULLs."""
    return metrics.join(scores, list(keys), "left")
