"""The bounded-task forms give the results of the one-shuffle forms, also under skew."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicegauge import AssessmentConfig, assess
from slicegauge.functions.hashing import draw_key
from slicegauge.operators import duplicates, nmi, quantiles, ranking, sampling, stats
from slicegauge.operators.quantiles import exact_quantiles
from slicegauge.session import materialize


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold far more than a third of the rows; long tails, missing values."""
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    x = np.where(rng.random(n) < 0.4, 5.0, rng.lognormal(0, 4, n) * rng.choice([-1, 1], n))
    x[rng.random(n) < 0.1] = np.nan
    y = np.round(x / 3 + rng.normal(0, 1, n), 1)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": y, "k": rng.integers(0, 4, n).astype(float)})
    pdf.loc[pdf.index % 7 == 0, "g"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("g", F.nullif(F.col("g"), F.lit("NaN")))


@pytest.mark.parametrize("small", [None, 0])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_pandas(skewed, small, by):
    pdf, df = skewed
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    got = exact_quantiles(df, ["x", "k"], probs, by, small).collect()
    groups = [(None, pdf)] if not by else [(None if pd.isna(k) else k, v) for k, v in pdf.groupby("g", dropna=False)]
    assert len(got) == 2 * len(groups)
    for key, part in groups:
        for c in ("x", "k"):
            row = next(r for r in got if r.column == c and (not by or r.g == key))
            assert row.n == part[c].count()
            assert row.q == pytest.approx(part[c].dropna().quantile(probs).tolist(), rel=1e-12)


def test_quantiles_with_infinity_and_constants(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (1.0, 1.0), (2.0, 1.0), (float("-inf"), 1.0), (3.0, None)], "x double, c double")
    for small in (None, 0):
        got = {r.column: r.q for r in exact_quantiles(df, ["x", "c"], [0.25, 0.5, 0.75], (), small).collect()}
        assert got == {"x": [1.0, 2.0, 3.0], "c": [1.0, 1.0, 1.0]}


@pytest.mark.parametrize("values", [
    [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1e-300, float("inf"), float("-inf"), 1.0],
    [1e9 + i / 7 for i in range(500)] + [1e9] * 900,
    [1e-12 * i for i in range(300)] + [0.015],
    [-3.0 - i * 1e-7 for i in range(400)] + [2.0 ** i for i in range(-40, 40)],
])
def test_quantiles_of_clustered_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = [i / 20 for i in range(21)]
    small, large = [exact_quantiles(df, ["x"], probs, (), limit).first() for limit in (None, 0)]
    assert small.n == large.n == len(values) and small.q == large.q


def test_bounded_quantiles_read_the_rows_three_times(spark, data, monkeypatch):
    """Two jobs with one scan each, then a plan with one scan, whatever the number of columns and ranks."""
    plans = []

    def kept(df):
        plans.append(df)
        return materialize(df)

    monkeypatch.setattr(quantiles, "materialize", kept)
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    plans.append(exact_quantiles(lines, ["l_quantity", "l_extendedprice", "l_tax"], [0, 0.3, 0.5, 1], ["l_returnflag"], 0))
    scans = [p._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice#") > 0 and
             p._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet") for p in plans]
    assert scans == [1, 1, 1]


def test_ranks_and_limits(skewed):
    _, df = skewed
    keyed = df.select("id", "g").withColumn("k", F.md5(F.col("id").cast("string")))
    for limit in (None, 40):
        a = ranking.hash_ranked(keyed, ["g"], "k", ["id"], limit=limit)
        b = ranking.hash_ranked(keyed.repartition(13), ["g"], "k", ["id"], limit=limit, small_bytes=0)
        assert rows_of(a) == rows_of(b)
    for by in ([], ["g"]):
        a, b = [ranking.first_rows(df.select("id", "g"), 25, "id", by, s) for s in (None, 0)]
        assert rows_of(a) == rows_of(b) and a.count() == (25 if not by else 100 + 25)


def test_spearman_equals_pandas(skewed):
    pdf, df = skewed
    for small in (None, 0):
        for r in stats.spearman(df, "x", "y", ["g"], small).collect():
            part = pdf[pdf.g.isna() if r.g is None else pdf.g == r.g].dropna(subset=["x", "y"])
            assert r.n == len(part)
            rank = part[["x", "y"]].rank()
            assert r.spearman_rho == pytest.approx(np.corrcoef(rank.x, rank.y)[0, 1], abs=1e-10)


def test_duplicates_equal_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": rng.choice(["u", "v"], 3000), "a": rng.integers(0, 40, 3000).astype(float),
                        "t": rng.choice(["x", "y", None], 3000, p=[0.8, 0.1, 0.1])})
    pdf.loc[pdf.a == 3, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("t", F.nullif(F.col("t"), F.lit("NaN")))
    # long texts, copies of one of them in a third of the rows
    long = F.when(F.col("a") < 14, F.repeat(F.lit("same text "), 50)).otherwise(F.repeat(F.col("t"), 200))
    for d in (df, df.withColumn("t", long)):
        want = d.toPandas()
        got = {r.s: r.n_duplicates for r in duplicates.duplicate_counts(d, ["s"]).collect()}
        assert got == {k: int(v.duplicated().sum()) for k, v in want.groupby("s")}
    assert duplicates.duplicate_counts(df.where("false"), []).first().n_duplicates == 0


def brute_nmi(a, b, n_bins=10):
    def cat(s):
        return pd.qcut(s, n_bins, duplicates="drop").astype(str) if pd.api.types.is_numeric_dtype(s) else s.astype(str)
    a, b = cat(a.dropna()), cat(b.dropna())
    both = a.index.intersection(b.index)
    joint = pd.crosstab(a[both], b[both], normalize=True).to_numpy()
    px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
    m = joint > 0
    mi = (joint[m] * np.log(joint[m] / (px @ py)[m])).sum()
    h = -(px * np.log(px)).sum() - (py * np.log(py)).sum()
    return 2 * mi / h if h else 0.0


@pytest.mark.parametrize("small", [None, 0])
def test_nmi_equals_brute_force(skewed, small):
    pdf, df = skewed
    for by in ([], ["g"]):
        for r in nmi.nmi_pairs(df.select("g", "x", "y", "k"), ["x", "y"], ["k"], by, small_bytes=small).collect():
            part = pdf if not by else pdf[pdf.g.isna() if r.g is None else pdf.g == r.g]
            assert r.nmi == pytest.approx(brute_nmi(part[r.feature], part["k"]), abs=1e-10)


def test_samples_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    lab = df.select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    calls = [lambda d, s: sampling.hash_sample(d, 50, "id", small_bytes=s),
             lambda d, s: sampling.stratified_bootstrap(d, "label", "id", [40, 81], small_bytes=s),
             lambda d, s: sampling.slice_by_label_share(d, "label", "id", [0.1, 0.5], 2500, small_bytes=s),
             lambda d, s: sampling.stratified_split(d, "label", "id", 42, small_bytes=s)]
    for f in calls:
        assert rows_of(f(lab.coalesce(1), None)) == rows_of(f(lab.repartition(16), 0))


@pytest.mark.parametrize("small", [None, 0])
def test_bucket_lookups_equal_full_ranking(skewed, small):
    """Flags and picked positions against a full sort of every group, the missing group included."""
    pdf, df = skewed
    keyed = df.select("id", "g", "x").withColumn("k", draw_key(1, "t", F.col("id"))).repartition(7)
    order = {}
    for i, g in zip(pdf["id"], pdf["g"]):
        order.setdefault(None if pd.isna(g) else g, []).append((hashlib.md5(f"1:t:{i}".encode()).hexdigest(), i))
    order = {g: [i for _, i in sorted(v)] for g, v in order.items()}
    for share in (0.0, 0.2, 1.0, 3.0):
        got = ranking.hash_flagged(keyed, ["g"], "k", F.floor(F.col("__n") * share), ["id"], "in", small)
        assert got.columns[-1] == "in" and got.count() == len(pdf)
        hits = {r["id"] for r in got.where("`in`").collect()}
        assert hits == {i for v in order.values() for i in v[:int(len(v) * share)]}
    asked = [(g, p, t) for g, v in order.items() for t, p in enumerate([1, 2, 2, len(v) // 2, len(v), len(v) + 5])]
    wanted = df.sparkSession.createDataFrame(asked, "g string, at long, t int")
    got = {(r.g, r.t): r.id for r in ranking.hash_picked(keyed, ["g"], "k", wanted, "at", ["id"], small).collect()}
    assert got == {(g, t): order[g][p - 1] for g, p, t in asked if p <= len(order[g])}
    none = keyed.where("false")
    assert ranking.hash_flagged(none, ["g"], "k", F.col("__n"), ["id"], "in", small).collect() == []
    assert ranking.hash_picked(none, ["g"], "k", wanted, "at", ["id"], small).collect() == []


def test_split_sorts_border_buckets_only(skewed):
    """In the bounded form no row outside a border bucket meets the window."""
    _, df = skewed
    split = sampling.stratified_split(df.select("id", (F.col("id") % 5 == 0).alias("label"), "x"), "label", "id", 42, small_bytes=0)
    rows = materialize(split)
    assert rows.where("is_test").count() == 1200
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number" in line]
    assert len(ranks) == 1 and plan.count("Union") == 1


def test_label_shares_and_replacement(skewed):
    _, df = skewed
    lab = df.select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    out = sampling.slice_by_label_share(lab, "label", "id", [0.1, 0.5], 2500, prefix="c_")
    got = {r.slice: (r.n, r.pos, r.ids) for r in out.groupBy("slice").agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"), F.count_distinct("id").alias("ids")).collect()}
    assert got["c_p010_slice_00"] == (2500, 250, 2500)
    n, pos, ids = got["c_p050_slice_01"]   # 1250 wanted of 1200: drawn with replacement
    assert (n, pos) == (2500, 1250) and ids < 2500


def test_bootstrap_and_permutation_paths_agree(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame([(d, f"s{i}", *rng.random(3)) for d in "pq" for i in range(9)], columns=["d", "s", "x", "y", "z"])
    df = spark.createDataFrame(pdf)
    pairs = stats.pairs_long(df, ["d", "s"], [("x", "y")]).drop("x_name", "y_name")
    a, b = [stats.bootstrap(pairs, ["d"], "s", 200, small_bytes=s) for s in (None, 0)]
    assert rows_of(a) == rows_of(b)
    a, b = [stats.permutation_delta_r2(df, ["d"], "s", "x", "z", "y", 100, small_bytes=s) for s in (None, 0)]
    assert rows_of(a) == rows_of(b)


def test_scorecard_paths_agree(skewed):
    _, df = skewed
    cfg = AssessmentConfig(protected_attributes=["k"], quasi_identifiers=["k"],
                           reference_distribution_rights={"k": {0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}})
    small, large = [assess(d, {}, cfg, ["g"], small_bytes=s)[1].select("g", "name", "score", "applicable")
                    for d, s in ((df, None), (df.repartition(11), 0))]
    assert rows_of(small) == rows_of(large)


def test_first_rows_puts_missing_values_first_in_both_forms(spark):
    from slicegauge.operators.ranking import first_rows
    rows = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "id long")
    got = [sorted(r.id if r.id is not None else -1 for r in first_rows(rows, 3, "id", small_bytes=b).collect()) for b in (1 << 30, 0)]
    assert got == [[-1, 0, 1], [-1, 0, 1]]


def test_block_bootstrap_agrees_with_rows(spark):
    """Intervals of blocks and of single rows agree to a few hundredths; nulls are left out, constants give no value."""
    from slicegauge.operators import stats
    rows = spark.range(3000).selectExpr("'a' AS g", "id AS k", "rand(1) AS x", "rand(1) + rand(2) AS y").unionByName(
        spark.range(50).selectExpr("'c' AS g", "id AS k", "1e9 + 0.1 AS x", "rand(3) AS y")).unionByName(
        spark.sql("SELECT 'a' AS g, 9999 AS k, CAST(NULL AS DOUBLE) AS x, 1.0D AS y")).cache()
    b = {r.g: r for r in stats.bootstrap_blocks(rows, ["g"], "k", 150, 400).collect()}
    one = {r.g: r for r in stats.bootstrap(rows.where("x IS NOT NULL"), ["g"], "k", 200).collect()}
    assert b["a"].n_rows == 3000 and b["c"].pearson_r is None and b["c"].n_resamples == 0
    assert abs(b["a"].pearson_r - one["a"].r_mean) < 0.01
    assert abs(b["a"].ci_low - one["a"].ci_low) < 0.02 and abs(b["a"].ci_high - one["a"].ci_high) < 0.02
    assert stats.bootstrap_blocks(rows.limit(0), ["g"], "k").count() == 0
