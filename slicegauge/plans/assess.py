"""The scorecard: 19 proxies and three composites for every slice in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions import sql
from ..functions.columns import clean, join_on, numeric_columns
from ..operators import metadata as md, quality, rights, safety
from ..operators.composite import composites
from ..operators.nmi import DECILES
from ..operators.proxy import Proxy, evaluate
from ..operators.quantiles import exact_quantiles
from ..schema import QUALITY, RIGHTS, SAFETY


@dataclass
class AssessmentConfig:
    """What the caller must state about a task; every field has a default."""

    application: str = "ML"
    target_rows_for_task: int = 10_000
    declared_features: Sequence[str] | None = None
    reference_distribution_quality: Mapping[str, Mapping[Any, float]] = field(default_factory=dict)
    domain_half_life_days: float = 365.0
    text_column: str | None = None
    physical_process_coupled: bool = False
    edge_case_specifications: Sequence[Mapping] | None = None
    has_human_subjects: bool = True
    protected_attributes: Sequence[str] = ()
    reference_distribution_rights: Mapping[str, Mapping[Any, float]] = field(default_factory=dict)
    quasi_identifiers: Sequence[str] = ()
    nmi_threshold: float = 0.2
    # evaluation time for ages; an operator never reads the clock
    as_of: str = "2026-06-09 00:00:00"
    # None reads every text; a number draws that many per slice
    text_sample_size: int | None = None
    text_key: str | None = None
    toxicity_classifier: safety.Toxicity = "lexicon"


def proxies(df: DataFrame, metadata: Mapping[str, Any], cfg: AssessmentConfig,
            by: Sequence[str] = (), small_bytes: int | None = None) -> list[Proxy]:
    """All 19 proxies of the cleaned table `df`, in scorecard order."""
    meta = md.Metadata(metadata)
    data = [c for c in df.columns if c not in by]
    half = cfg.domain_half_life_days
    # One quantile pass feeds the outlier bounds and the NMI bins; the two uses
    # share its exchange.
    prot = [c for c in cfg.protected_attributes if c in data]
    nums = numeric_columns(df, data, with_bool=bool(prot))
    quartiles = deciles = None
    if nums:
        probs = [0.25, 0.75, *(DECILES if prot else [])]
        q = exact_quantiles(df, nums, probs, by, small_bytes)
        quartiles = q.withColumn("q", F.slice("q", 1, 2))
        deciles = q.withColumn("q", F.slice("q", 3, len(DECILES))) if prot else None
    out = [
        quality.appropriate_amount_proxy(cfg.target_rows_for_task),
        quality.representativeness_proxy(df, cfg.reference_distribution_quality, by),
        md.source_trustworthiness(meta),
        quality.free_of_error_proxy(df, by, quartiles, small_bytes),
        md.objectivity(meta),
        quality.relevance_proxy(df, cfg.declared_features),
        md.timeliness(meta, cfg.as_of, half),
        md.source_security(meta),
        md.poisoning_susceptibility(meta),
        md.adversarial_provenance_risk(meta),
        md.factual_decay_rate(meta, cfg.as_of, half),
        safety.harm_content_proxy(df, cfg.text_column, by, cfg.text_sample_size, key=cfg.text_key,
                                  classifier=cfg.toxicity_classifier, small_bytes=small_bytes),
        safety.physical_harm_proxy(df, cfg.text_column, by, cfg.text_sample_size, key=cfg.text_key,
                                   small_bytes=small_bytes),
        safety.edge_case_proxy(df, cfg.edge_case_specifications, cfg.physical_process_coupled),
    ]
    subject = [
        rights.representation_gap_proxy(df, cfg.protected_attributes, cfg.reference_distribution_rights, by),
        md.consent_provenance(meta),
        rights.reidentification_proxy(df, cfg.quasi_identifiers, by),
        rights.inferential_harm_proxy(df, cfg.protected_attributes, by, cfg.nmi_threshold, deciles, small_bytes),
        md.contestability(meta),
    ]
    if not cfg.has_human_subjects:
        subject = [p.excluded(overridden_by="has_human_subjects=False", original_applicable=True)
                   for p in subject]
    return out + subject


def assess(df: DataFrame, metadata: Mapping[str, Any], cfg: AssessmentConfig | None = None,
           by: Sequence[str] = (), groups: DataFrame | None = None,
           small_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(composites, long scores) of a table, or of each of its slices.

    `by` names the slice columns; they are not scored. `groups` may list the
    wanted slices so that empty ones appear. Both results are lazy.
    """
    cfg = cfg or AssessmentConfig()
    df = clean(df)
    scores = evaluate(df, proxies(df, metadata, cfg, by, small_bytes), by, groups)
    return composites(scores, cfg.application, [*by, "n_rows"]), scores


def slice_records(scores: DataFrame, application: str, by: Sequence[str] = ("dataset", "slice")) -> DataFrame:
    """One nested record per slice: composites, excluded names, scores and details.

    The shape a JSON sink writes; one row per slice, so no dataset is gathered
    into one object.
    """
    comp = composites(scores, application, [*by, "n_rows"])
    per_axis = {a: f"map_from_entries(transform(filter(breakdown, x -> x.axis = '{a}'), x -> struct(x.name, x.score)))"
                for a in (QUALITY, SAFETY, RIGHTS)}
    base = comp.select(*by, "n_rows", F.lit(application).alias("application"),
                       F.col("quality").alias("Q"), F.col("safety").alias("S"), F.col("rights").alias("R"),
                       "excluded_for_na", F.expr(sql.struct(per_axis)).alias("per_sub_dimension"))
    # at most one entry per proxy and slice
    details = scores.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(".", "axis", "name"), F.struct("applicable", "raw_value", "details")))).alias("details"))
    return join_on(base, details, list(by))


def explode_records(records: DataFrame) -> DataFrame:
    """Nested per-dataset score files (a `slices` array) to one row per slice."""
    s = records.select("dataset", "application", F.explode("slices").alias("s"))
    names = s.schema["s"].dataType.names
    rest = [F.col(f"s.{n}").alias(n) for n in names if n != "name"]
    return s.select("dataset", "application", F.col("s.name").alias("slice"), *rest)
