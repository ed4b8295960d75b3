"""Fairness metrics on hand-made predictions."""

import pytest

from conftest import local_frame
from slicegauge.operators import factuality, fairness as fm


def preds(spark, rows):
    return local_frame(spark, rows, "run string, y_true int, y_pred int, prot__sex string, prot__age double")


def test_gaps(spark):
    rows = ([("r", 1, 1, "f", 1.0)] * 3 + [("r", 0, 1, "f", 1.0)] + [("r", 1, 0, "m", None)] * 2
            + [("r", 0, 0, "m", None)] * 2 + [("q", 1, 1, "f", 2.0)])
    df = preds(spark, rows)
    got = {(r.run, r.attribute): (r.n_groups, r.dpd, r.eod) for r in fm.attribute_gaps(
        fm.subgroups(df, ["sex", "age", "absent"], ["run"]), ["run"]).collect()}
    assert got["r", "sex"] == (2, 1.0, 1.0) and got["q", "sex"] == (1, None, None)
    assert got["r", "age"] == (2, 1.0, 1.0)
    assert got["r", "absent"] == got["q", "absent"] == (0, None, None)
    gap = {r.run: r.worst_subgroup_error_gap for r in fm.subgroup_error_gap(df, ["sex", "age"], ["run"]).collect()}
    assert gap == {"r": 0.25, "q": 0.0}
    s = {r.run: r for r in fm.run_metrics(df, ["sex", "age"], ["run"]).collect()}
    assert (s["r"].n_test, s["r"].accuracy) == (8, 0.625)
    assert (s["r"].worst_subgroup_attr, s["r"].worst_subgroup_group) == ("sex", "m")


def test_eod_needs_both_rates(spark):
    df = preds(spark, [("r", 1, 1, "f", 1.0), ("r", 0, 1, "f", 1.0), ("r", 1, 0, "m", 1.0)])
    r = fm.equalized_odds_difference(df, ["sex"], ["run"]).first()
    assert r.eod is None and r.n_groups == 2


def test_worst_subgroup_ties(spark):
    df = preds(spark, [("r", 1, 0, "m", 5.0), ("r", 1, 0, "f", 5.0), ("r", 1, 0, None, 5.0)])
    g = fm.subgroups(df, ["age", "sex"], ["run"])
    assert fm.worst_subgroup(g, ["run"]).first()[1:] == (0.0, "age", "5.0")
    g = fm.subgroups(df, ["sex"], ["run"])
    assert fm.worst_subgroup(g, ["run"]).first()[1:] == (0.0, "sex", "f")
    only = fm.subgroups(df.where("prot__sex IS NULL"), ["sex"], ["run"])
    assert fm.worst_subgroup(only, ["run"]).first().worst_subgroup_group == "nan"


def test_multiple_choice(spark):
    bench = spark.createDataFrame([("q1", ["a", "b"], [1, 0], ["a", "b", "c"], [1, 0, 1]), ("q2", ["a", "b"], [0, 1], ["a"], [0])],
                                  "question string, mc1_choices array<string>, mc1_labels array<int>, mc2_choices array<string>, mc2_labels array<int>")
    one = factuality.explode_choices(bench, "mc1").selectExpr("*", "-1.0D AS ll")
    r = factuality.mc1(one, "question").first()
    assert (r.mc1, r.n_questions) == (0.5, 2)      # equal likelihoods: the first choice wins
    two = factuality.explode_choices(bench, "mc2").selectExpr("*", "CAST(-idx AS DOUBLE) AS ll")
    import math
    z = [1, math.exp(-1), math.exp(-2)]
    assert factuality.mc2(two, "question").first().mc2 == pytest.approx(((z[0] + z[2]) / sum(z) + 0) / 2)


def test_metrics_without_attributes(spark):
    df = preds(spark, [("r", 1, 1, "f", 1.0), ("r", 0, 1, "f", 1.0)])
    for names in ([], ["absent"]):
        r = fm.run_metrics(df, names, ["run"]).first()
        assert (r.n_test, r.accuracy, r.worst_subgroup_accuracy, r.worst_subgroup_attr, r.worst_subgroup_group) == (2, 0.5, None, None, None)
        assert (r.dpd_worst, r.eod_worst, r.worst_subgroup_error_gap) == (None, None, None)
        assert fm.worst_subgroup(fm.subgroups(df, names, ["run"]), ["run"]).where("worst_subgroup_accuracy IS NOT NULL").count() == 0


def test_score_columns_for_metrics(spark):
    from slicegauge.schema import PROXIES
    rows = [("d", s, i, axis, name, 0.25, True, 0.25, "{}") for s in ("a", None) for i, (axis, name) in enumerate(PROXIES)]
    scores = local_frame(spark, rows, "dataset string, slice string, ord int, axis string, name string, score double, applicable boolean, raw_value double, details string")
    got = fm.scores_for_metrics(scores, "ML").collect()
    assert {(r.slice, r.Q, r.S, r.R, r.demographic_representation_gap, r.harm_content_density, r.application) for r in got} == {
        (s, 0.25, 0.25, 0.25, 0.25, 0.25, "ML") for s in ("a", None)}
