"""From a dataset description to scored slices: loader, slicing strategy, scorecard."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import url_category
from ..functions.columns import clean
from ..operators import sampling as sm
from .assess import AssessmentConfig, assess

Loader = Callable[[SparkSession, Mapping[str, Any]], DataFrame]


def slice_table(df: DataFrame, spec: Mapping[str, Any], prefix: str = "", seed: int = 42) -> DataFrame:
    """Cut a table into a long frame with a `slice` column by a named strategy.

    Common entries of `spec`: strategy, column (what to slice on), key (a
    unique row column for reproducible draws). The rest depends on the strategy.
    """
    kind, col, key = spec["strategy"], spec.get("column"), spec.get("key")
    cap = spec.get("rows_per_slice")
    if kind == "by_state":
        suffix = f"_{spec['year']}" if "year" in spec else ""
        return sm.slice_by_key(df, col, key, spec.get("states"), cap, seed, prefix, suffix)
    if kind == "stratified_bootstrap":
        sizes = spec["sample_sizes"]
        if len(sizes) != spec.get("n_slices", len(sizes)):
            raise ValueError("n_slices and sample_sizes disagree")
        return sm.stratified_bootstrap(df, col, key, sizes, seed, prefix)
    if kind == "by_admission_year":
        return sm.slice_by_ranges(df, col, spec["year_groups"], prefix)
    if kind == "by_discharge_cohort":
        return sm.slice_by_cohort(df, col, key, spec.get("cohort_groups"), spec.get("min_rows_per_slice", 1000),
                                  cap, seed, prefix)
    if kind == "toxicity_stratified":
        return sm.slice_by_label_share(df, col, key, spec["toxicity_proportions"], cap, seed, prefix)
    if kind == "by_domain_category":
        cats = list(spec["category_groups"])
        rows = sm.quota_per_category(df, url_category(F.col(col)), key, cats, cap)
        place = F.array_position(F.array(*[F.lit(c) for c in cats]), F.col("category")) - 1
        return rows.withColumn("slice", F.format_string(f"{prefix}%s_slice_%02d", "category", place))
    raise ValueError(f"unknown slicing strategy {kind!r}")


def score_dataset(spark: SparkSession, cfg: Mapping[str, Any], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(composites, long scores) of all slices of one dataset, with its name.

    `cfg` holds name, loader (a callable), slicing, metadata and config (an
    AssessmentConfig or its fields). Without a slicing spec the loader's own
    `slice` column is used.
    """
    df = clean(cfg["loader"](spark, cfg))
    spec = cfg.get("slicing")
    if spec:
        df = slice_table(df, spec, spec.get("prefix", ""), seed)
        extra = [c for c in ("draw", "category", spec.get("key")) if c and c in df.columns and c not in spec.get("keep", ())]
        df = df.drop(*extra)
    conf = cfg["config"]
    conf = conf if isinstance(conf, AssessmentConfig) else AssessmentConfig(**conf)
    composite, scores = assess(df, cfg["metadata"], conf, ["slice"])
    name = F.lit(cfg["name"]).alias("dataset")
    return composite.select(name, "*"), scores.select(name, "*")
