"""Every registered query with an SQL twin gives the twin's rows, names and types."""

import pytest

from compare import connect, oracle_rows, spark_rows, type_gaps
from workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    cols, rows = spark_rows(df)
    cols2, rows2 = oracle_rows(con, ORACLES[name])
    assert cols == cols2
    assert type_gaps(df, con, ORACLES[name]) == {}
    assert len(rows) == len(rows2) > 0
    assert rows == rows2


@pytest.mark.parametrize("name", [
    "exact_quantiles", "safe_spearman", "hash_sample", "slice_by_key", "slice_by_cohort", "stratified_bootstrap", "slice_by_label_share",
    "slice_manifest", "quota_per_category", "quota_per_category_capped", "stratified_split", "nmi_pairs", "inferential_harm", "free_of_error",
    "free_of_error_lineitem", "iqr_outlier_rate", "harm_density_sampled", "bootstrap_corr_ci", "assess_scorecard"])
def test_bounded_forms_match_sql(spark, data, con, name, monkeypatch):
    """The forms for inputs of any size give the same rows."""
    monkeypatch.setattr("slicegauge.session.SMALL_BYTES", 0)
    assert spark_rows(QUERIES[name](spark, data))[1] == oracle_rows(con, ORACLES[name])[1]
