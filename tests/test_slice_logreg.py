"""All slices in one job against Spark ML slice by slice."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from slicegauge.operators import slice_logreg
from slicegauge.operators.models import feature_frame, preprocessor
from slicegauge.operators.sampling import stratified_split
from slicegauge.operators.slice_logreg import logreg_slices, weights


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(9_300).selectExpr(
        "CASE WHEN id < 300 THEN 'a' WHEN id < 9260 THEN 'b' ELSE 'small' END AS slice", "id AS key",
        "IF(id % 97 = 0, NULL, CAST(pmod(hash(id), 100) + pmod(hash(id, 1), 60) > 80 AS INT)) AS target", "IF(id % 11 = 0, NULL, CAST(pmod(hash(id), 100) AS DOUBLE)) AS x",
        "IF(id % 13 = 0, NULL, IF(hash(id, 2) % 3 = 0, 'u', 'v')) AS c", "CAST(NULL AS DOUBLE) AS void", "IF(id < 300, NULL, 'w') AS d", "id % 3 = 0 AS sex")


def test_agrees_with_spark_ml(rows):
    features, seeds = ["x", "c", "void", "d", "sex"], (42, 43, 44)
    pred, state, columns = logreg_slices(rows, "target", "key", features, ["sex"], seeds)
    assert {c for c in columns} == {("x__x", None), ("x__void", None), ("x__sex", None), ("x__c", "u"), ("x__c", "v"), ("x__d", "w")}
    got = {(r["slice"], r.seed): dict(zip([*columns, "bias"], r.w)) for r in weights(state, columns, seeds).collect()}
    assert set(got) == {(s, k) for s in "ab" for k in seeds}
    for name, seed in (("a", 42), ("b", 44)):
        flat, nums, cats = feature_frame(rows.where(f"slice = '{name}' AND target IS NOT NULL"), features, ["key", "CAST(target AS DOUBLE) AS y_true"][:1] + ["target"])
        flat = flat.withColumn("y_true", flat.target.cast("double")).withColumn("key", flat.key.cast("string"))
        train = stratified_split(flat, "y_true", "key", seed).where("NOT is_test").drop("is_test").cache()
        pipe, modes = preprocessor(train, nums, cats)
        ready = pipe.fit(train.fillna(modes)).transform(train.fillna(modes))
        ml = LogisticRegression(featuresCol="features", labelCol="y_true", maxIter=2000, tol=1e-14, regParam=1 / train.count(), standardization=False).fit(ready)
        names = [("x__x", None), ("x__sex", None), ("x__c", "u"), ("x__c", "v"), ("x__d", "w")] if name == "b" else [("x__x", None), ("x__sex", None), ("x__c", "u"), ("x__c", "v")]
        want = dict(zip(names, ml.coefficients.toArray()))
        mine = got[name, seed]
        assert len(want) == len(ml.coefficients)
        assert abs(mine["bias"] + sum(mine.get(c, 0) for c in [("x__d", "w")] if name == "b") - ml.intercept - want.get(("x__d", "w"), 0)) < 1e-5
        for c, v in want.items():
            assert abs(mine[c] - v) < 1e-5, c
        assert mine["x__void", None] == 0
    test = pred.where("slice = 'b' AND seed = 43")
    assert pred.columns == ["slice", "model_family", "seed", "key", "y_true", "y_pred", "y_score", "prot__sex"]
    r = test.selectExpr("avg(CAST(y_true = y_pred AS INT))", "count(*)", "count(DISTINCT key)").first()
    assert r[0] > 0.75 and r[1] == r[2] and abs(r[1] - 0.2 * 8868) < 20


def test_empty_and_too_many_levels(spark, rows):
    pred, state, _ = logreg_slices(rows.limit(0), "target", "key", ["x"], seeds=(1,))
    assert pred.count() == 0 and state.count() == 0
    with pytest.raises(ValueError):
        logreg_slices(rows.withColumn("c", rows.key.cast("string")), "target", "key", ["c"], seeds=(1,))


def test_begin_on_some_blocks_ends_at_the_same_weights(rows, monkeypatch):
    """all steps from zero saw all rows. Those that begin near the end are few, and end where the others do."""
    monkeypatch.setattr(slice_logreg, "BLOCK_ROWS", 64)
    packed, columns = slice_logreg.blocks(rows.withColumn("target", F.expr("CAST(x > 50 AS INT)")), "target", "key", ["x", "c", "sex"], (42, 43), 0.2)
    found = []
    for many in (0, 10**9):
        state = slice_logreg.fit(packed, columns, 2, many=many)
        found.append({(r["slice"], r.seed): (r.rounds, r.w) for r in weights(state, columns, (42, 43)).collect()})
    near, far = found
    assert set(near) == set(far) == {(s, k) for s in "ab" for k in (42, 43)}
    assert all(np.abs(np.subtract(near[x][1], far[x][1])).max() < 1e-7 for x in near)
    assert near["b", 42][0] < far["b", 42][0] - 3


def test_large_offsets_and_constants(spark):
    """Centred blocks keep a small spread about a large mean; a constant column weighs nothing."""
    rows = spark.range(4000).selectExpr("'a' AS slice", "id AS key", "1.6e9D + pmod(hash(id), 100) AS x", "0.1D AS same",
                                        "CAST(pmod(hash(id), 100) + pmod(hash(id, 1), 40) > 70 AS INT) AS target")
    small = rows.withColumn("x", F.expr("x - 1.6e9D"))
    got = [weights(state, columns, (1,)).first().w for _, state, columns in (logreg_slices(r, "target", "key", ["x", "same"], seeds=(1,)) for r in (rows, small))]
    assert np.abs(np.subtract(*got)).max() < 1e-5 and got[0][1] == 0 and abs(got[0][0]) > 1
