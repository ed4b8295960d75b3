"""Readers, sinks and the dataset driver."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from slicegauge import AssessmentConfig, assess
from slicegauge.operators import tables
from slicegauge.operators.metadata import select_datasets
from slicegauge.plans.datasets import score_dataset, slice_table
from slicegauge.sources import readers as rd, sinks


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n1,x\n2,\n")
    assert rd.read_csv(spark, str(tmp_path / "plain.csv")).collect() == [(1, "x"), (2, None)]
    (tmp_path / "raw.data").write_text("A91 30 1\nA92 41 2\n")
    raw = rd.read_csv(spark, str(tmp_path / "raw.data"), header=False, sep=" ", names=["status", "age", "risk"])
    assert raw.columns == ["status", "age", "risk"] and raw.count() == 2
    (tmp_path / "semi.csv").write_text('"p";"q"\n1.5;2\n')
    assert rd.read_csv(spark, str(tmp_path / "semi.csv"), sep=";").first() == (1.5, 2)
    (tmp_path / "tok.csv").write_text("race, sex\n?, M\nA , Unknown/Invalid\n")
    tok = rd.read_csv(spark, str(tmp_path / "tok.csv"), schema="race string, sex string",
                      null_tokens=["?", "Unknown/Invalid"], trim=True)
    assert tok.collect() == [(None, "M"), ("A", None)]
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a\n" + "\n".join(map(str, range(10))))
    z = rd.read_csv(spark, str(tmp_path / "z.csv.gz"), schema="a int", partitions=4)
    assert z.count() == 10 and z.rdd.getNumPartitions() == 4


def test_run_records(spark, tmp_path):
    for i, rec in enumerate([{"slice": "s", "model_family": "m", "seed": 1, "mc1": 0.2, "mc2": 0.4, "status": "ok"},
                             {"slice": "s", "model_family": "m", "seed": 2, "status": "failed", "error": "boom"}]):
        (tmp_path / f"r{i}.json").write_text(json.dumps(rec, indent=2))
    ok, bad = tables.run_records(rd.read_json_records(spark, str(tmp_path)), "comments")
    assert [(r.dataset, r.seed, r.mc2) for r in ok.collect()] == [("comments", 1, 0.4)]
    assert [(r.seed, r.error) for r in bad.collect()] == [(2, "boom")]


def test_score_files_round_trip(spark, tmp_path):
    df = spark.range(40).selectExpr("IF(id < 10, 'a', 'b') AS slice", "id % 3 AS x")
    c, s = assess(df, {"content_type": "mixed"}, AssessmentConfig(has_human_subjects=False), ["slice"])
    s = s.withColumn("dataset", F.lit("d"))
    sinks.write_scores(s, "ML", str(tmp_path / "scores"))
    back = spark.read.json(str(tmp_path / "scores"))
    want = {r.slice: (r.n_rows, r.quality) for r in c.collect()}
    assert {r.slice: (r.n_rows, pytest.approx(r.Q)) for r in back.collect()} == want
    row = back.where("slice = 'a'").first()
    assert row.per_sub_dimension.quality.objectivity == 0.5 and "contestability" in row.excluded_for_na


def test_nested_score_file(spark, tmp_path):
    rec = {"dataset": "d", "application": "ML", "n_slices": 2, "slices": [
        {"name": "s0", "n_rows": 5, "Q": 0.5, "S": 0.1, "R": None, "excluded_for_na": ["x"],
         "per_sub_dimension": {"quality": {"q": 0.5}, "safety": {}, "rights": {"r": None}}},
        {"name": "s1", "n_rows": 6, "Q": 0.6, "S": 0.2, "R": 0.3, "excluded_for_na": []}]}
    (tmp_path / "d.json").write_text(json.dumps(rec, indent=2))
    got = {r.slice: (r.Q, r.R) for r in rd.read_scores(spark, str(tmp_path)).collect()}
    assert got == {"s0": (0.5, None), "s1": (0.6, 0.3)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "slice string, v int")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rd.read_csv(spark, str(tmp_path / "c")).count() == 2
    sinks.write_slices(df, str(tmp_path / "p"))
    assert (tmp_path / "p" / "slice=a").exists() and rd.read_parquet(spark, str(tmp_path / "p")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_missing_inputs_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    inputs = {"a": [str(tmp_path / "a.csv")], "b": [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")], "c": [str(tmp_path / "a.csv")]}

    def load(s, name):
        if name == "c":
            raise RuntimeError("broken")
        return rd.read_csv(s, inputs[name][0])
    frames, status = rd.read_available(spark, inputs, load)
    assert set(frames) == {"a"}
    assert {r.dataset: r.status for r in status.collect()} == {"a": "ok", "b": "skipped", "c": "failed"}


def test_dataset_driver(spark):
    base = spark.range(3000).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' ELSE 'NY' END AS state",
                                        "CAST(id % 7 = 0 AS INT) AS label", "CAST(1990 + id % 20 AS INT) AS year",
                                        "id % 90 AS age")
    cfg = {"name": "acs", "loader": lambda s, c: base, "metadata": {"consent_type": "opt_in"},
           "slicing": {"strategy": "by_state", "column": "state", "key": "id", "states": ["CA", "TX"], "year": 2018,
                       "rows_per_slice": 500, "prefix": "acs_"},
           "config": {"target_rows_for_task": 1000, "quasi_identifiers": ["age"]}}
    c, s = score_dataset(spark, cfg)
    assert {(r.dataset, r.slice, r.n_rows) for r in c.collect()} == {("acs", "acs_CA_2018", 500), ("acs", "acs_TX_2018", 500)}
    n = {k: slice_table(base, v, "p_").groupBy("slice").count().count() for k, v in {
        "boot": {"strategy": "stratified_bootstrap", "column": "label", "key": "id", "sample_sizes": [50, 60]},
        "year": {"strategy": "by_admission_year", "column": "year", "year_groups": [[1990, 1995], [1995], [2050]]},
        "cohort": {"strategy": "by_discharge_cohort", "column": "state", "key": "id", "min_rows_per_slice": 1000, "rows_per_slice": 900},
        "share": {"strategy": "toxicity_stratified", "column": "label", "key": "id", "toxicity_proportions": [0.1, 0.2], "rows_per_slice": 100},
    }.items()}
    assert n == {"boot": 2, "year": 2, "cohort": 3, "share": 2}
    with pytest.raises(ValueError):
        slice_table(base, {"strategy": "nope"})


def test_unknown_datasets_are_rejected(spark):
    cat = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, stage int")
    got = {(r.dataset, r.status) for r in select_datasets(cat, "dataset", ["a", "zzz"]).collect()}
    assert got == {("a", "ok"), ("zzz", "unknown")}
    assert [r.dataset for r in select_datasets(cat, "dataset", where={"stage": 2}).collect()] == ["b"]
