"""Rights proxies that read the data (high = risky)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions import sql
from ..functions.columns import clean
from .nmi import feature_max, nmi_pairs
from .proxy import Proxy, not_applicable, single
from .quality import variation_parts
from .shares import class_sizes


def representation_gap_proxy(df: DataFrame, protected: Sequence[str],
                             reference: Mapping[str, Mapping[Any, float]],
                             by: Sequence[str] = ()) -> Proxy:
    name = "demographic_representation_gap"
    if not protected:
        return not_applicable(name, 0.0, "no protected attributes")
    cols = [c for c in protected if c in df.columns and c in reference and c not in by]
    if not cols:
        return not_applicable(name, 0.0, "no protected attribute has a reference")
    frame, cells, mean = variation_parts(df, reference, cols, by, "__gap")
    return Proxy(name, mean, raw_value=mean, frames=[frame], details={"per_attribute_tv": sql.struct(cells)})


def demographic_representation_gap(df: DataFrame, protected: Sequence[str],
                                   reference: Mapping[str, Mapping[Any, float]],
                                   by: Sequence[str] = ()) -> DataFrame:
    """Mean total variation distance of protected attributes to a population."""
    return single(df, representation_gap_proxy(df, protected, reference, by), by)


def reidentification_proxy(df: DataFrame, quasi_identifiers: Sequence[str], by: Sequence[str] = (),
                           k_threshold: int = 5) -> Proxy:
    name = "reidentification_risk"
    if not quasi_identifiers:
        return not_applicable(name, 0.0, "no quasi-identifiers")
    cols = [c for c in quasi_identifiers if c in df.columns]
    if not cols:
        return not_applicable(name, 0.0, "no quasi-identifier is in the table")
    frame = (class_sizes(df, [c for c in cols if c not in by], by)
             .withColumnsRenamed({"k": "__reid_k", "n_classes": "__reid_n"}))
    k = "coalesce(__reid_k, 1)"
    risk = f"1 / (1 + {k} / {float(max(1, k_threshold))!r}D)"
    return Proxy(name, risk, raw_value=k, frames=[frame], details={
        "k_observed": k, "k_threshold": str(k_threshold), "n_classes": "coalesce(__reid_n, 0)"})


def reidentification_risk(df: DataFrame, quasi_identifiers: Sequence[str], by: Sequence[str] = (),
                          k_threshold: int = 5) -> DataFrame:
    """1 / (1 + k / threshold) for the smallest class over the quasi-identifiers."""
    df = clean(df)
    return single(df, reidentification_proxy(df, quasi_identifiers, by, k_threshold), by)


def inferential_harm_proxy(df: DataFrame, protected: Sequence[str], by: Sequence[str] = (),
                           threshold: float = 0.2, quantiles: DataFrame | None = None,
                           small_bytes: int | None = None) -> Proxy:
    name = "inferential_harm_potential"
    if not protected:
        return not_applicable(name, 0.0, "no protected attributes")
    prot = [c for c in protected if c in df.columns and c not in by]
    if not prot:
        return not_applicable(name, 0.0, "no protected attribute is in the table")
    features = [c for c in df.columns if c not in prot and c not in by]
    if not features:
        return Proxy(name, "0.0D", raw_value="0", details={"reason": "'no other feature to evaluate'"})
    best = feature_max(nmi_pairs(df, features, prot, by, quantiles=quantiles, small_bytes=small_bytes), by)
    hit = F.col("max_nmi") >= threshold
    frame = best.groupBy(*by).agg(
        F.count_if(hit).alias("__inf_n"),
        # bounded by the number of columns
        F.array_sort(F.collect_list(F.when(hit, F.col("feature")))).alias("__inf_names"))
    raw = sql.struct({"flagged": "coalesce(__inf_names, array())", "n_candidate_features": str(len(features))})
    return Proxy(name, f"coalesce(__inf_n, 0) / {float(len(features))!r}D", raw_value=f"to_json({raw})",
                 frames=[frame], details={"threshold": sql.value(float(threshold))})


def inferential_harm_potential(df: DataFrame, protected: Sequence[str], by: Sequence[str] = (),
                               threshold: float = 0.2, small_bytes: int | None = None) -> DataFrame:
    """Share of other features whose NMI with a protected attribute reaches the threshold."""
    df = clean(df)
    return single(df, inferential_harm_proxy(df, protected, by, threshold, None, small_bytes), by)
