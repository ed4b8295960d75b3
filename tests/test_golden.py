"""Published slice means reproduce the published correlations."""

import pytest

from slicegauge.operators import stats
from slicegauge.plans import hypotheses as hy

SLICES = """00_n400 0.717005590 0.742500000 0.459714286 0.220000000 0.452814408 0.227848841 0.380358286
01_n500 0.725972083 0.766000000 0.460514286 0.224000000 0.386821207 0.258738118 0.379552945
02_n600 0.735512083 0.774444444 0.460047619 0.221666667 0.468843386 0.289371636 0.294071820
03_n700 0.744474792 0.787142857 0.460000000 0.221428571 0.337532785 0.253582187 0.250988234
04_n800 0.753690330 0.790416667 0.455214286 0.197500000 0.434103178 0.252160513 0.264485304
05_n900 0.763778317 0.785925926 0.451047619 0.176666667 0.370539192 0.274297233 0.283162527
06_n1000 0.773520915 0.805000000 0.459514286 0.219000000 0.476778620 0.273335562 0.240462828
07_n1000 0.772819616 0.801333333 0.454514286 0.194000000 0.585550089 0.289654618 0.289580467"""
COLS = ["Q", "accuracy", "R", "demographic_representation_gap", "eod_worst", "dpd_worst", "worst_subgroup_error_gap"]
EXPECTED = {("R", "eod_worst"): (-0.1120839, -0.1666667), ("R", "dpd_worst"): (-0.3006115, -0.2380952),
            ("R", "worst_subgroup_error_gap"): (0.2878992, 0.3571429),
            ("demographic_representation_gap", "worst_subgroup_error_gap"): (0.2878992, 0.3571429)}


@pytest.fixture(scope="module")
def metrics(spark):
    rows = []
    for line in SLICES.splitlines():
        name, *v = line.split()
        rows += [("credit", name, m, *map(float, v)) for m in ("a", "b")]
    rows += [("wine", f"w{i}", "a", 0.1 * i, 0.2, None, None, 0.1, 0.2, 0.3) for i in range(5)]
    rows += [("tiny", f"t{i}", "a", 0.1 * i, 0.3 * i, 0.1, 0.2, 0.1, 0.2, 0.3) for i in range(3)]
    schema = "dataset string, slice string, model_family string, " + ", ".join(f"{c} double" for c in COLS)
    return spark.createDataFrame(rows, schema)


def test_h1(metrics):
    got = {r.dataset: r for r in hy.quality_accuracy(metrics, 300).collect()}
    r = got["credit"]
    assert r.pearson_r == pytest.approx(0.9368276, abs=1e-6) and r.spearman_rho == pytest.approx(0.9285714, abs=1e-6)
    assert r.status == "ok" and r.n_slices == 8 and r.ci_low < r.pearson_r < r.ci_high and r.ci_low > 0.5
    assert r.interpretation.startswith("strong positive (r=0.94); CI excludes zero")
    assert got["wine"].status == "all_resamples_invalid" and got["wine"].pearson_r is None
    assert got["tiny"].status == "underpowered" and got["tiny"].interpretation == "underpowered (n_slices=3)"


def test_h2(metrics):
    rows = hy.rights_fairness(metrics, 50).collect()
    got = {(r.x_name, r.y_name): (r.pearson_r, r.spearman_rho) for r in rows if r.dataset == "credit"}
    assert len(got) == 6
    for k, v in EXPECTED.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
    assert [(r.status, r.x_name) for r in rows if r.dataset == "wine"] == [("rights_axis_not_applicable", None)]


def test_h4_statuses(spark, metrics):
    uq = metrics.selectExpr("dataset", "slice", "IF(dataset = 'wine', 0.5, Q * 0.9 + accuracy * 0.1) AS q_uniform").distinct()
    got = {r.dataset: r for r in hy.conditional_weights(metrics, uq, 50).collect()}
    assert got["wine"].status == "no_predictor_variance" and got["tiny"].status == "underpowered"
    r = got["credit"]
    assert r.status == "ok" and r.n_permutations == 50 and r.delta_r2 == pytest.approx(r.r2_conditional - r.r2_uniform)
    assert r.interpretation.startswith("uniform > conditional")


def test_degenerate_correlations(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0), ("s", 1.0, 2.0), ("s", None, 3.0),
                                ("s", 2.0, float("nan"))], "g string, x double, y double")
    got = {r.g: (r.n, r.pearson_r) for r in stats.pearson(df, "x", "y", ["g"]).collect()}
    assert got == {"c": (3, None), "s": (1, None)}
    got = {r.g: r.spearman_rho for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert got == {"c": None, "s": None}
