"""The model grid: learns, records failures, keeps unseen labels and missing values."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from slicegauge.operators import fairness as fm
from slicegauge.session import materialize
from slicegauge.operators.models import EarlyStopped, FAMILIES, iterations_of, gbt, most_frequent, preprocessor, feature_frame, train_predict, _wide_preprocessor


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(700).selectExpr(
        "CASE WHEN id < 300 THEN 'a' WHEN id < 660 THEN 'b' ELSE 'small' END AS slice", "id AS key",
        "CAST(pmod(hash(id), 100) > 50 AS INT) AS target", "IF(id % 11 = 0, NULL, CAST(pmod(hash(id), 100) AS DOUBLE)) AS x",
        "IF(id % 13 = 0, NULL, IF(id % 2 = 0, 'u', 'v')) AS c", "CAST(NULL AS DOUBLE) AS void", "id % 3 = 0 AS sex")


def test_grid(rows):
    small = {"logreg": FAMILIES["logreg"], "gbt": lambda n, w, s: gbt(n, w, s).setMaxIter(3), "mlp": lambda n, w, s: FAMILIES["mlp"](n, w, s).setMaxIter(30),
             "broken": lambda n, w, s: (_ for _ in ()).throw(RuntimeError("no"))}
    pred, out = train_predict(rows, "target", "key", ["sex"], ["x", "c", "void", "sex"], list(small), [42], factories=small)
    o = {(r.slice, r.model_family): (r.status, r.error) for r in out.collect()}
    told = {(r.slice, r.model_family): (r.iterations, r.fit_time_seconds) for r in out.collect()}
    assert told["a", "gbt"][0] == 3 and 0 < told["b", "mlp"][0] <= 30 and told["a", "logreg"][1] > 0 and told["a", "broken"] == (None, None)
    assert o["small", None] == ("failed", "slice too small: 40 rows")
    assert o["a", "broken"] == ("failed", "RuntimeError: no") and o["b", "gbt"][0] == "ok"
    assert pred.columns == ["slice", "model_family", "seed", "y_true", "y_pred", "y_score", "prot__sex"]
    acc = {(r.slice, r.model_family): (r.n_test, r.accuracy) for r in fm.overall_accuracy(pred, ["slice", "model_family"]).collect()}
    assert acc["a", "logreg"][0] == acc["a", "gbt"][0] and 50 < acc["a", "gbt"][0] < 70
    assert acc["a", "gbt"][1] > 0.85 and acc["b", "logreg"][1] > 0.8
    with pytest.raises(ValueError):
        train_predict(rows, "target", "key", families=["nope"])


def test_early_stopping(spark):
    """Noise is not learned for long, the best round stays, warm starts go on where the round before ended."""
    ready = spark.range(600).selectExpr("id", "rand(1) AS a", "rand(2) AS b", "id % 7 = 0 AS is_valid").selectExpr(
        "a", "b", "CAST(IF(rand(3) < 0.3, rand(4) < 0.5, a > 0.5) AS DOUBLE) AS y_true", "is_valid")
    ready = materialize(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ready))
    stopped = EarlyStopped([2, 64, 32, 16, 2], 1, step=10).fit(ready)
    plain = EarlyStopped([2, 64, 32, 16, 2], 1, max_iter=200, step=200).fit(ready)  # one round, on the same training rows
    assert stopped.iterations < plain.iterations == iterations_of(plain)

    def loss(model):
        p = vector_to_array("probability")[F.col("y_true").cast("int")]
        return model.transform(ready.where("is_valid")).agg(F.avg(-F.log(F.greatest(F.lit(1e-15), p)))).first()[0]
    assert loss(stopped) <= loss(plain)
    first = EarlyStopped([2, 8, 2], 1, max_iter=10, step=10).fit(ready)
    assert loss(EarlyStopped([2, 8, 2], 1, max_iter=40, step=10, patience=9).fit(ready)) <= loss(first)


def test_a_stuck_start_is_left_and_a_good_round_is_kept(spark):
    """Equal weights never part; a later round out of the finite range costs its own weights only."""
    ready = spark.range(400).selectExpr("randn(1) AS a", "randn(2) AS b", "id % 7 = 0 AS is_valid").selectExpr(
        "a", "b", "CAST(a > 0.5 AS DOUBLE) AS y_true", "is_valid")
    ready = materialize(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ready))

    class Lost:
        def __init__(self, model):
            self.weights, self.summary, self.model = model.weights, model.summary, model

        def transform(self, df):
            nan = F.lit(float("nan"))
            return self.model.transform(df).withColumn("probability", array_to_vector(F.array(nan, nan)))

    class Stuck(EarlyStopped):
        def _round(self, train, iterations, weights, *seed):
            if weights is None and seed in ((), (self.seed,)):
                model = super()._round(train, 1, None, *seed)
                weights = Vectors.dense([0.0] * model.weights.size)
            return super()._round(train, iterations, weights, *seed)

    class Leaves(EarlyStopped):
        def _round(self, train, iterations, weights, *seed):
            model = super()._round(train, iterations, weights, *seed)
            return model if weights is None else Lost(model)

    hit = (vector_to_array("probability")[1] >= 0.5) == (F.col("y_true") == 1)
    for kind in (Stuck, Leaves):
        model = kind([2, 8, 2], 1, max_iter=120, step=20).fit(ready)
        assert model.transform(ready.where("is_valid")).agg(F.avg(hit.cast("int"))).first()[0] > 0.9, kind


def test_unseen_labels_and_modes(spark, rows):
    flat, nums, cats = feature_frame(rows, ["x", "c"], ["key"])
    assert most_frequent(flat, cats) == {"x__c": "u"}
    pipe, modes = preprocessor(flat, nums, cats)
    model = pipe.fit(flat.fillna(modes))
    new = spark.createDataFrame([(1, 5.0, "never")], "key long, x__x double, x__c string")
    v = model.transform(new).first().features.toArray()
    assert len(v) == 3 and list(v[1:]) == [0.0, 0.0]


def test_features_are_one_expression(spark, rows):
    """Same vectors as Spark ML's stages (many levels take those), but one function call a row instead of one a stage."""
    flat, nums, cats = feature_frame(rows, ["x", "c", "void", "sex"], ["key"])
    got, want = preprocessor(flat, nums, cats), _wide_preprocessor(flat, nums, cats)
    assert got[1] == want[1]
    filled = flat.fillna(got[1])
    vectors = [p.fit(filled).transform(filled).select("key", "features") for p in (got[0], want[0])]
    for a, b in zip(*(v.orderBy("key").collect() for v in vectors)):
        assert a.features.toArray() == pytest.approx(b.features.toArray(), abs=1e-12)
    calls = [v._jdf.queryExecution().optimizedPlan().toString().count("UDF(") for v in vectors]
    assert calls[0] == 1 < calls[1]
    many, _, wide = feature_frame(rows.withColumn("c", F.concat(F.lit("v"), F.col("key") % 90)), ["c"], ["key"])
    assert len(preprocessor(many, [], wide)[0].fit(many).transform(many).first().features) == 90
