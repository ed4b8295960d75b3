"""The full scorecard: a tabular dataset sliced by status, a text corpus by language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from slicegauge.operators.composite import passes_threshold
from slicegauge.plans.assess import AssessmentConfig, assess
from . import sqlgen as G
from .catalog import composite_sql
from .data_scores import _PII, _TOX
from .registry import AS_OF, Tables, query, rounded

META = {"source_identifier": "https://example.org/orders", "collection_methodology": "order entry system",
        "institutional_pedigree": False, "versioning": True, "license": "", "content_type": "transactional",
        "data_collection_end": "2024-12-31", "checksum_published": True, "access_logging": True,
        "write_access_controls": True, "cryptographic_provenance": False, "source_count": 3, "ugc_fraction": 0.1,
        "anonymous_contributions": False, "scraping_breadth": "narrow", "consent_type": "opt_in",
        "subject_consent_documented": True, "license_for_current_use": "internal", "data_use_agreement": False,
        "subject_access_process": True, "correction_process": True, "deletion_process": False,
        "contact_for_subject_rights": True}
# What the documentation above is worth, by hand: (score, applicable).
_AGE = "(epoch_us(TIMESTAMP '" + AS_OF + "') - epoch_us(TIMESTAMP '2024-12-31')) / 86400e6"
META_SQL = {"source_trustworthiness": "3 / 5.0", "objectivity": "1.0", "source_security": "2 / 4.0",
            "poisoning_susceptibility": "1 - 0.4 - 0.15", "adversarial_provenance_risk": "0.5 * 0.1",
            "consent_provenance": "0.2 - 0.1 - 0.05", "contestability": "1 - 3 / 4.0"}

REF_PRIO = {"o_orderpriority": {"1-URGENT": 0.3, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.1}}
ORDERS_CFG = AssessmentConfig(
    application="ML", target_rows_for_task=10_000,
    declared_features=["o_orderpriority", "o_totalprice", "o_orderdate", "c_age"],
    reference_distribution_quality=REF_PRIO, domain_half_life_days=3650.0, physical_process_coupled=True,
    edge_case_specifications=[{"name": "huge", "filter": "o_totalprice > 499000", "min_count": 5},
                              {"name": "old", "filter": "o_orderdate < timestamp'1992-01-10 00:00:00'"}],
    protected_attributes=["o_orderpriority"], reference_distribution_rights=REF_PRIO,
    quasi_identifiers=["o_orderpriority", "y"], nmi_threshold=0.0005, as_of=AS_OF)
_ORD = "ord AS (SELECT o_orderstatus, o_custkey, o_totalprice, o_orderpriority, o_orderdate, CAST(year(o_orderdate) AS INT) AS y FROM orders)"
_OCOL = ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate", "y"]


def orders_table(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate",
                           F.year("o_orderdate").alias("y"))


def _row(name: str, axis: str, expr: str, ok: str = "true") -> tuple[str, str, str, str]:
    return name, axis, expr, ok


def scorecard_sql(by: str, rows: Sequence[tuple[str, str, str, str]], source: str) -> str:
    """Long scores (by, n_rows, ord, axis, name, score, applicable) from one wide relation."""
    return " UNION ALL ".join(
        f"SELECT {by}, n_rows, {i} AS ord, '{axis}' AS axis, '{name}' AS name, "
        f"greatest(0.0, least(1.0, CAST({expr} AS DOUBLE))) AS score, {ok} AS applicable FROM {source}"
        for i, (name, axis, expr, ok) in enumerate(rows, start=1))


ORDERS_WIDE = f"""{_ORD}, base AS (SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (o_totalprice > 499000) AS e1,
    count(*) FILTER (o_orderdate < TIMESTAMP '1992-01-10') AS e2 FROM ord GROUP BY 1),
  tv AS ({G.tv_sql('ord', REF_PRIO, 'o_orderstatus')}),
  foe AS ({G.error_sql('ord', _OCOL, ['o_custkey', 'o_totalprice', 'y'], 'o_orderstatus')}),
  kan AS ({G.kanon_sql('ord', ['o_orderpriority', 'y'], 'o_orderstatus')}),
  inf AS (SELECT o_orderstatus, count(*) FILTER (nmi >= 0.0005) / 4.0 AS share FROM (
    {G.nmi_sql('ord', ['o_custkey', 'o_totalprice', 'y'], ['o_orderdate', 'o_orderpriority'], ['o_orderpriority'], 'o_orderstatus')}) GROUP BY 1),
  wide AS (SELECT base.*, tv.tv, foe.score AS foe, kan.risk, inf.share FROM base JOIN tv USING (o_orderstatus)
    JOIN foe USING (o_orderstatus) JOIN kan USING (o_orderstatus) JOIN inf USING (o_orderstatus))"""
ORDERS_ROWS = [
    _row("appropriate_amount", "quality", "n_rows / 10000.0"), _row("representativeness", "quality", "1 - tv"),
    _row("source_trustworthiness", "quality", META_SQL["source_trustworthiness"]), _row("free_of_error", "quality", "foe"),
    _row("objectivity", "quality", META_SQL["objectivity"]), _row("relevance", "quality", "3 / 4.0"),
    _row("timeliness", "quality", f"exp(-{_AGE} / 3650.0)"), _row("source_security", "quality", META_SQL["source_security"]),
    _row("poisoning_susceptibility", "safety", META_SQL["poisoning_susceptibility"]),
    _row("adversarial_provenance_risk", "safety", META_SQL["adversarial_provenance_risk"]),
    _row("factual_decay_rate", "safety", f"1 - exp(-{_AGE} / 3650.0)"),
    _row("harm_content_density", "safety", "0", "false"), _row("physical_harm_enablement_density", "safety", "0", "false"),
    _row("safety_critical_edge_case_coverage", "safety", "1 - (CAST(e1 >= 5 AS INT) + CAST(e2 >= 1 AS INT)) / 2.0"),
    _row("demographic_representation_gap", "rights", "tv"), _row("consent_provenance", "rights", META_SQL["consent_provenance"]),
    _row("reidentification_risk", "rights", "risk"), _row("inferential_harm_potential", "rights", "share"),
    _row("contestability", "rights", META_SQL["contestability"])]


@query("assess_scorecard", f"""WITH {ORDERS_WIDE}, sc AS ({scorecard_sql('o_orderstatus', ORDERS_ROWS, 'wide')}),
  c AS ({composite_sql('ML', 'o_orderstatus, n_rows')}),
  x AS (SELECT o_orderstatus, coalesce(string_agg(CASE WHEN NOT applicable THEN name END, ',' ORDER BY ord), '') AS excluded FROM sc GROUP BY 1)
  SELECT o_orderstatus, n_rows, round(quality, 8) + 0.0 AS quality, round(safety, 8) + 0.0 AS safety, round(rights, 8) + 0.0 AS rights,
    excluded, quality >= 0.7 AND coalesce(safety <= 0.2, true) AND coalesce(rights <= 0.2, true) AS passes FROM c JOIN x USING (o_orderstatus)""")
def assess_scorecard(t: Tables) -> DataFrame:
    composite, _ = assess(orders_table(t), META, ORDERS_CFG, ["o_orderstatus"])
    return composite.withColumn("passes", passes_threshold()).selectExpr(
        "o_orderstatus", "n_rows", *rounded("quality", "safety", "rights"), "array_join(excluded_for_na, ',') AS excluded", "passes")


@query("assess_scores_long", f"""WITH {ORDERS_WIDE} SELECT o_orderstatus, CAST(ord AS INT) AS ord, axis, name, round(score, 8) + 0.0 AS score, applicable
  FROM ({scorecard_sql('o_orderstatus', ORDERS_ROWS, 'wide')})""")
def assess_scores_long(t: Tables) -> DataFrame:
    _, scores = assess(orders_table(t), META, ORDERS_CFG, ["o_orderstatus"])
    return scores.selectExpr("o_orderstatus", "ord", "axis", "name", *rounded("score"), "applicable")


# Text corpus; the rights axis does not apply.
DOCS_META = {"content_type": "opinion", "last_updated": "2023-06-30T12:00:00+02:00", "ugc_fraction": 1.0,
             "anonymous_contributions": True, "scraping_breadth": "web_scale", "consent_type": "scraped"}
DOCS_CFG = AssessmentConfig(application="LLM", target_rows_for_task=500, declared_features=["text"], text_column="text",
                            has_human_subjects=False, protected_attributes=["source"], quasi_identifiers=["source"], as_of=AS_OF)
_DAGE = "(epoch_us(TIMESTAMP '" + AS_OF + "') - epoch_us(TIMESTAMP '2023-06-30 10:00:00')) / 86400e6"
DOCS_WIDE = f"""docs AS (SELECT lang, text, source, n_chars FROM documents), base AS (SELECT lang, count(*) AS n_rows,
    greatest(count(*) FILTER ({_TOX}), count(*) FILTER ({_PII})) / CAST(count(*) AS DOUBLE) AS harm FROM docs GROUP BY 1),
  foe AS ({G.error_sql('docs', ['text', 'source', 'n_chars'], ['n_chars'], 'lang')}),
  kan AS ({G.kanon_sql('docs', ['source'], 'lang')}),
  inf AS (SELECT lang, count(*) FILTER (nmi >= 0.2) / 2.0 AS share FROM ({G.nmi_sql('docs', ['n_chars'], ['text', 'source'], ['source'], 'lang')}) GROUP BY 1),
  wide AS (SELECT base.*, foe.score AS foe, kan.risk, inf.share FROM base JOIN foe USING (lang) JOIN kan USING (lang) JOIN inf USING (lang))"""
DOCS_ROWS = [
    _row("appropriate_amount", "quality", "n_rows / 500.0"), _row("representativeness", "quality", "0.5", "false"),
    _row("source_trustworthiness", "quality", "0"), _row("free_of_error", "quality", "foe"), _row("objectivity", "quality", "0.1"),
    _row("relevance", "quality", "1"), _row("timeliness", "quality", f"exp(-{_DAGE} / 365.0)"), _row("source_security", "quality", "0"),
    _row("poisoning_susceptibility", "safety", "1"), _row("adversarial_provenance_risk", "safety", "1"),
    _row("factual_decay_rate", "safety", f"1 - exp(-{_DAGE} / 365.0)"), _row("harm_content_density", "safety", "harm"),
    _row("physical_harm_enablement_density", "safety", "0"), _row("safety_critical_edge_case_coverage", "safety", "0", "false"),
    _row("demographic_representation_gap", "rights", "0", "false"), _row("consent_provenance", "rights", "0.8", "false"),
    _row("reidentification_risk", "rights", "risk", "false"), _row("inferential_harm_potential", "rights", "share", "false"),
    _row("contestability", "rights", "1", "false")]


@query("score_slices", f"""WITH {DOCS_WIDE}, sc AS ({scorecard_sql('lang', DOCS_ROWS, 'wide')}) SELECT lang AS slice, n_rows, CAST(ord AS INT) AS ord, name,
  round(score, 8) + 0.0 AS score, applicable FROM sc""")
def score_slices(t: Tables) -> DataFrame:
    _, scores = assess(t.documents.drop("doc_id"), DOCS_META, DOCS_CFG, ["lang"])
    return scores.selectExpr("lang AS slice", "n_rows", "ord", "name", *rounded("score"), "applicable")


@query("score_slices_composite", f"""WITH {DOCS_WIDE}, sc AS ({scorecard_sql('lang', DOCS_ROWS, 'wide')}) SELECT lang AS slice, n_rows,
  round(quality, 8) + 0.0 AS Q, round(safety, 8) + 0.0 AS S, round(rights, 8) AS R FROM ({composite_sql('LLM', 'lang, n_rows')})""")
def score_slices_composite(t: Tables) -> DataFrame:
    composite, _ = assess(t.documents.drop("doc_id"), DOCS_META, DOCS_CFG, ["lang"])
    return composite.selectExpr("lang AS slice", "n_rows", "round(quality, 8) + 0.0D AS Q", "round(safety, 8) + 0.0D AS S",
                                "round(rights, 8) AS R")
