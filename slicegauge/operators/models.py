"""Tabular models per slice on Spark ML: preprocessing, families, fit grid.

Fitting is distributed inside Spark ML; the driver only walks the list of
slices, seeds and families, each of which is configuration-sized, a few at a time.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_double, numeric_columns
from ..functions.hashing import draw_int, draw_key
from ..session import materialize, new_table
from .fairness import PREFIX
from .sampling import stratified_split

MIN_ROWS = 50
# Share of the training rows that early stopping validates on, by the md5 order of their keys.
VALIDATION_SHARE = 0.15
# Up to so many levels of all text columns, the feature vector is one array of plain expressions.
NARROW = 64
# Training rows that make a partition of their own.
PARTITION_ROWS = 50_000


def logreg(n_train: int, width: int, seed: int) -> Estimator:
    """L2 logistic regression; the mean loss makes 1/n the unit penalty strength."""
    return LogisticRegression(featuresCol="features", labelCol="y_true", maxIter=2000, elasticNetParam=0.0,
                              regParam=1.0 / max(1, n_train), standardization=False)


def gbt(n_train: int, width: int, seed: int) -> Estimator:
    return GBTClassifier(featuresCol="features", labelCol="y_true", maxIter=100, maxDepth=4, stepSize=0.1,
                         seed=seed, cacheNodeIds=True, checkpointInterval=10)


class EarlyStopped(Estimator):
    """A perceptron fitted in rounds of `step` iterations, each starting from the weights of the one before.

    After every round the mean log loss of the validation rows (`is_valid`) is
    taken; a start ends when it has not fallen by `tol` for `patience` rounds,
    when the optimiser converges, gives up or leaves the finite range. A start
    that tells the validation rows no better than their label shares is stuck:
    the fit starts again from other weights, `starts` times and `max_iter`
    iterations in all at most. The weights of the best round of all stay.
    Without rows on both sides it is a plain fit.
    """

    def __init__(self, layers: Sequence[int], seed: int, max_iter: int = 500, step: int = 20, patience: int = 2, tol: float = 1e-4, starts: int = 3):
        super().__init__()
        self.layers, self.seed, self.max_iter, self.step, self.patience, self.tol, self.starts = list(layers), seed, max_iter, step, patience, tol, starts

    def setMaxIter(self, value: int) -> EarlyStopped:
        self.max_iter = value
        return self

    def _round(self, train: DataFrame, iterations: int, weights, seed: int) -> Model:
        net = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y_true", layers=self.layers, maxIter=iterations, seed=seed)
        return (net if weights is None else net.setInitialWeights(weights)).fit(train)

    def _start(self, train: DataFrame, valid: DataFrame, seed: int, most: int) -> tuple[Model | None, float, int]:
        """Best model of one start, its validation loss and the iterations taken."""
        p = F.greatest(F.lit(1e-15), vector_to_array("probability")[F.col("y_true").cast("int")])
        best, least, waited, done, weights = None, math.inf, 0, 0, None
        while done < most and waited < self.patience:
            ask = min(self.step, most - done)
            model = self._round(train, ask, weights, seed)
            ran, weights = model.summary().totalIterations, model.weights
            done += ran
            loss = model.transform(valid).agg(F.avg(-F.log(p))).first()[0]
            if not math.isfinite(loss):
                break
            waited = 0 if loss < least - self.tol else waited + 1
            if loss < least:
                best, least = model, loss
            if ran < ask:
                break
        return best, least, done

    def _fit(self, ready: DataFrame) -> Model:
        train, valid = ready.where(~F.col("is_valid")), ready.where("is_valid")
        sides = {r["is_valid"]: r for r in ready.groupBy("is_valid").agg(F.avg("y_true").alias("share")).collect()}
        if len(sides) < 2:
            model = self._round(ready, self.max_iter, None, self.seed)
            model.iterations = model.summary().totalIterations
            return model
        # log loss of the validation rows if every one got the share of label 1
        share = sides[True]["share"]
        stuck = -sum(x * math.log(x) for x in (share, 1 - share) if x > 0) * 0.99
        best, least, done = None, math.inf, 0
        for i in range(self.starts):
            model, loss, ran = self._start(train, valid, self.seed + i * 7919, self.max_iter - done)
            done += ran
            if loss < least:
                best, least = model, loss
            if least < stuck or done >= self.max_iter:
                break
        if best is None:
            raise ArithmeticError("the optimiser left the finite range")
        best.iterations = done
        return best


def mlp(n_train: int, width: int, seed: int) -> Estimator:
    return EarlyStopped([width, 64, 32, 16, 2], seed)


def iterations_of(model: Model) -> int | None:
    """Iterations, or trees, that a fitted model took; None where it does not tell."""
    if hasattr(model, "iterations"):
        return model.iterations
    if hasattr(model, "getNumTrees"):
        return model.getNumTrees
    return model.summary.totalIterations if getattr(model, "hasSummary", False) else None


FAMILIES: dict[str, Callable[[int, int, int], Estimator]] = {"logreg": logreg, "gbt": gbt, "mlp": mlp}


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, c): rows of every level of the text columns. A scan per column reads that column only, and no row is multiplied."""
    each = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")) for c in columns]
    return reduce(DataFrame.unionByName, each)


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Mode of each text column, smallest value on ties: one row per column is collected."""
    if not columns:
        return {}
    top = level_counts(df, columns).groupBy("column").agg(F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in top.collect()}


def feature_frame(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Features as doubles (numeric, boolean) or strings (all else), plus other columns."""
    nums = numeric_columns(df, features, with_bool=True)
    cats = [c for c in features if c in df.columns and c not in nums]
    cols = [as_double(df, c).alias(f"x__{c}") for c in nums] + [F.col(c).cast("string").alias(f"x__{c}") for c in cats]
    return df.select(*keep, *cols), [f"x__{c}" for c in nums], [f"x__{c}" for c in cats]


class Prepared(Transformer):
    """Features from known means, scales and levels, as one array of plain expressions that becomes a vector once."""

    def __init__(self, numbers: Sequence[tuple[str, float, float]], levels: Sequence[tuple[str, str]]):
        super().__init__()
        self.numbers, self.levels = list(numbers), list(levels)

    def _transform(self, df: DataFrame) -> DataFrame:
        cells = [(F.coalesce(F.col(c), F.lit(mean)) - mean) * F.lit(1 / dev if dev else 0.0) for c, mean, dev in self.numbers]
        cells += [F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)) for c, level in self.levels]
        return df.withColumn("features", array_to_vector(F.array(*cells))).withMetadata("features", {"ml_attr": {"num_attrs": len(cells)}})


def preprocessor(train: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> tuple[Pipeline, dict[str, str]]:
    """Mean-impute and standardize numbers, one-hot text; unseen labels are all zeros.

    Two reads of the training rows tell all that is fitted. With more than
    `NARROW` levels Spark ML's stages take over, whose vectors are sparse.
    """
    found = level_counts(train, cats).limit(NARROW + 1).collect() if cats else []
    if len(found) > NARROW:
        return _wide_preprocessor(train, nums, cats)
    levels = {c: sorted((r["value"], r["c"]) for r in found if r["column"] == c) for c in cats}
    modes = {c: max(pairs, key=lambda p: p[1])[0] for c, pairs in levels.items() if pairs}
    numbers = []
    if nums:
        fits = [F.struct(F.count(c).alias("k"), F.avg(c).alias("mean"), F.var_samp(c).alias("var")).alias(c) for c in nums]
        have = train.agg(F.count(F.lit(1)).alias("n"), *fits).first()
        # an imputed cell adds nothing to the squares; a column without any training value carries nothing to impute from
        numbers = [(c, have[c]["mean"], math.sqrt((have[c]["var"] or 0.0) * (have[c]["k"] - 1) / max(1, have["n"] - 1)))
                   for c in nums if have[c]["k"] > 0]
    hot = [(c, value) for c, pairs in levels.items() for value, _ in pairs]
    if not numbers and not hot:
        raise ValueError("no feature has a training value")
    return Pipeline(stages=[Prepared(numbers, hot)]), modes


def _wide_preprocessor(train: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> tuple[Pipeline, dict[str, str]]:
    """The same by Spark ML's stages."""
    # a column without any training value carries nothing to impute from
    if nums:
        have = train.agg(*[F.count(c).alias(c) for c in nums]).first()
        nums = [c for c in nums if have[c] > 0]
    modes = most_frequent(train, cats)
    cats = [c for c in cats if c in modes]
    stages: list[Any] = []
    parts = []
    if nums:
        filled = [f"{c}__f" for c in nums]
        stages += [Imputer(strategy="mean", inputCols=list(nums), outputCols=filled),
                   VectorAssembler(inputCols=filled, outputCol="nums"),
                   StandardScaler(inputCol="nums", outputCol="scaled", withMean=True, withStd=True)]
        parts.append("scaled")
    if cats:
        idx, hot = [f"{c}__i" for c in cats], [f"{c}__h" for c in cats]
        stages += [StringIndexer(inputCols=list(cats), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True)]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages), modes


def _split_fits(rows: DataFrame, n: int, nums: list[str], cats: list[str], name: str, seed: int, families, test_size, factories, path: str):
    """Outcome rows of one slice and seed; every fit's predictions are a folder of their own under `path`."""
    try:
        # the md5 of the key picks the validation rows, so that they need no shuffle and never change; the key itself is done with
        valid = draw_int(draw_key(seed, "valid", F.col("__key"))) % 10_000 < int(VALIDATION_SHARE * 10_000)
        split = materialize(stratified_split(rows, "y_true", "__key", seed, test_size).withColumn("is_valid", valid).drop("slice", "__key"))
        train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
        pipe, modes = preprocessor(train, nums, cats)
        prepared = pipe.fit(train.fillna(modes))
        ready = prepared.transform(train.fillna(modes)).select("features", "y_true", "is_valid")
        held = prepared.transform(test.fillna(modes))
        n_train = train.count()
        n_test = n - n_train
        width = ready.schema["features"].metadata["ml_attr"]["num_attrs"]
        # every iteration is a job over these partitions: small ones are put together
        ready = ready.coalesce(max(1, n_train // PARTITION_ROWS))
        # the logistic regression reads its rows twice and then holds them itself; all else comes back to them
        if any(factories[f] is not logreg for f in families):
            ready = materialize(ready)
    except Exception as e:  # one bad split must not stop the grid
        return [(name, None, seed, "failed", f"{type(e).__name__}: {e}", 0, 0, None, None)]
    outcomes = []
    for fam in families:
        try:
            start = time.perf_counter()
            model = factories[fam](n_train, width, seed).fit(ready)
            took = time.perf_counter() - start
            score = vector_to_array("probability")[1]
            model.transform(held).select(
                F.lit(name).alias("slice"), F.lit(fam).alias("model_family"), F.lit(seed).alias("seed"),
                F.col("y_true").cast("int").alias("y_true"), (score >= 0.5).cast("int").alias("y_pred"),
                score.alias("y_score"), *[c for c in rows.columns if c.startswith(PREFIX)]).write.parquet(f"{path}/{uuid.uuid4().hex}")
            outcomes.append((name, fam, seed, "ok", None, n_train, n_test, iterations_of(model), took))
        except Exception as e:  # recorded, not raised
            outcomes.append((name, fam, seed, "failed", f"{type(e).__name__}: {e}", n_train, n_test, None, None))
    return outcomes


OUTCOME = "slice string, model_family string, seed int, status string, error string, n_train long, n_test long, iterations int, fit_time_seconds double"


def train_predict(slices: DataFrame, target: str, key: str, protected: Sequence[str] = (),
                  features: Sequence[str] | None = None, families: Sequence[str] = ("logreg", "gbt", "mlp"),
                  seeds: Sequence[int] = (42, 43, 44, 45, 46), test_size: float = 0.2,
                  factories: Mapping[str, Callable[[int, int, int], Estimator]] | None = None, parallelism: int = 4
                  ) -> tuple[DataFrame, DataFrame]:
    """(predictions, outcomes) of every slice x seed x family.

    Rows without a target are dropped. Declared protected columns stay among
    the features; undeclared features are all columns but target, key, slice
    and protected ones. Failures become outcome rows. `parallelism` splits are
    in work at a time, as the jobs of one fit of a small slice leave a cluster idle.
    """
    factories = dict(FAMILIES if factories is None else factories)
    unknown = [f for f in families if f not in factories]
    if unknown:
        raise ValueError(f"unknown model family {unknown[0]!r}; known: {', '.join(factories)}")
    if not features:
        features = [c for c in slices.columns if c not in {target, key, "slice", *protected}]
    rows = slices.where(F.col(target).isNotNull())
    keep = ["slice", F.col(key).alias("__key"), F.col(target).cast("int").cast("double").alias("y_true"),
            *[F.col(p).alias(PREFIX + p) for p in protected if p in slices.columns]]
    flat, nums, cats = feature_frame(rows, features, keep)
    flat = materialize(flat, "slice")
    path = new_table(slices.sparkSession)
    prot = [flat.schema[c] for c in flat.columns if c.startswith(PREFIX)]
    schema = T.StructType([T.StructField("slice", T.StringType()), T.StructField("model_family", T.StringType()), T.StructField("seed", T.IntegerType()),
                           T.StructField("y_true", T.IntegerType()), T.StructField("y_pred", T.IntegerType()), T.StructField("y_score", T.DoubleType()), *prot])
    slices.sparkSession.createDataFrame([], schema).write.parquet(path)
    counts = {r["slice"]: r["n"] for r in flat.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(n for n in counts if n is not None)
    outcomes = [(name, None, None, "failed", f"slice too small: {counts[name]} rows", 0, 0, None, None) for name in names if counts[name] < MIN_ROWS]
    fit = inheritable_thread_target(slices.sparkSession)(lambda name, seed: _split_fits(
        flat.where(F.col("slice") == name), counts[name], nums, cats, name, seed, families, test_size, factories, path))
    with ThreadPoolExecutor(parallelism) as pool:
        runs = [pool.submit(fit, name, seed) for name in names if counts[name] >= MIN_ROWS for seed in seeds]
        for run in runs:
            outcomes += run.result()
    out = slices.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return out, slices.sparkSession.createDataFrame(outcomes, OUTCOME)
