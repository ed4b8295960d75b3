"""Proxies read from documentation flags: one expression per proxy, no scan of data.

The same expressions serve a metadata dictionary (literals) and a catalog
table with one row per dataset (columns), so a whole catalog is one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import sql
from ..functions.dates import age_days, decay, parse_iso
from .proxy import Proxy, long_scores

TRUST_FIELDS = ("source_identifier", "collection_methodology", "institutional_pedigree",
                "versioning", "license")
SECURITY_FIELDS = ("checksum_published", "signed_releases", "access_logging", "chain_of_custody")
CONTEST_FIELDS = ("subject_access_process", "correction_process", "deletion_process",
                  "contact_for_subject_rights")

# What each documented category is worth. Sums of them are taken as decimals:
# 0.8 - 0.1 in doubles lies above 0.7, and a composite then fails a gate that it meets.
OBJECTIVITY = {"measurement": 1.0, "transactional": 1.0, "reference": 1.0, "mixed": 0.5,
               "opinion": 0.1, "review": 0.1, "subjective_survey": 0.1}
BREADTH = {"narrow": 0.0, "medium": 0.3, "broad": 0.7, "web_scale": 1.0}
CONSENT = {"opt_in": 0.2, "opt_out": 0.5, "inferred": 0.8, "scraped": 0.8, "none": 1.0}


class Metadata:
    """Typed SQL access to documentation fields of a dictionary or a catalog table."""

    def __init__(self, source: Mapping[str, Any] | DataFrame):
        self._dict = None if isinstance(source, DataFrame) else dict(source)
        self._types = ({f.name: f.dataType for f in source.schema.fields}
                       if isinstance(source, DataFrame) else {})

    def truthy(self, field: str) -> str:
        """Present, non-empty, non-zero."""
        if self._dict is not None:
            return sql.value(bool(self._dict.get(field)))
        kind, c = self._types.get(field), sql.name(field)
        if kind is None:
            return "false"
        if isinstance(kind, T.BooleanType):
            return f"coalesce({c}, false)"
        if isinstance(kind, T.StringType):
            return f"coalesce({c} <> '', false)"
        if isinstance(kind, T.NumericType):
            return f"coalesce(nanvl(CAST({c} AS DOUBLE), NULL) <> 0, false)"
        return f"({c} IS NOT NULL)"

    def text(self, field: str) -> str:
        if self._dict is not None:
            v = self._dict.get(field)
            return "CAST(NULL AS STRING)" if v is None else sql.value(str(v))
        return f"CAST({sql.name(field) if field in self._types else 'NULL'} AS STRING)"

    def number(self, field: str, default: float) -> str:
        if self._dict is not None:
            v = self._dict.get(field)
            return sql.value(float(default if v is None else v))
        if field not in self._types:
            return sql.value(float(default))
        return f"coalesce(nanvl(CAST({sql.name(field)} AS DOUBLE), NULL), {float(default)!r}D)"

    def dated(self) -> str:
        """End of collection, else last update; empty strings count as missing."""
        return (f"coalesce(nullif({self.text('data_collection_end')}, ''), "
                f"nullif({self.text('last_updated')}, ''))")


def _checklist(meta: Metadata, proxy: str, fields: Sequence[str], inverse: bool = False) -> Proxy:
    n = sql.plus(f"CAST({meta.truthy(f)} AS INT)" for f in fields)
    share = f"{n} / {float(len(fields))!r}D"
    present = ", ".join(f"IF({meta.truthy(f)}, {sql.value(f)}, NULL)" for f in fields)
    return Proxy(proxy, f"1 - {share}" if inverse else share, raw_value=n,
                 details={"present": f"array_compact(array({present}))"})


def source_trustworthiness(meta: Metadata) -> Proxy:
    """Share of five provenance fields that are filled in."""
    return _checklist(meta, "source_trustworthiness", TRUST_FIELDS)


def source_security(meta: Metadata) -> Proxy:
    """Share of four integrity controls that are declared."""
    return _checklist(meta, "source_security", SECURITY_FIELDS)


def contestability(meta: Metadata) -> Proxy:
    """Share of four data-subject processes that are missing."""
    return _checklist(meta, "contestability", CONTEST_FIELDS, inverse=True)


def objectivity(meta: Metadata) -> Proxy:
    """Declared content type on a fact-to-opinion scale; undeclared is N/A."""
    kind = meta.text("content_type")
    return Proxy("objectivity", sql.choose(kind, OBJECTIVITY, "0.5D"), f"{kind} IS NOT NULL", kind,
                 {"content_type": kind, "reason": f"IF({kind} IS NULL, 'content type not declared', NULL)"})


def _dated(meta: Metadata, proxy: str, half_life_days: float, as_of: str, unreadable: float,
           score: str) -> Proxy:
    raw, days = "__date_text", "__age_days"
    kept = score.format(decay(days, half_life_days))
    return Proxy(
        proxy,
        f"CASE WHEN {raw} IS NULL THEN 0.5D ELSE coalesce({kept}, {unreadable!r}D) END",
        f"{raw} IS NOT NULL", f"coalesce(CAST({days} AS STRING), {raw})",
        {"age_days": days, "half_life_days": sql.value(float(half_life_days)),
         "reason": f"CASE WHEN {raw} IS NULL THEN 'no collection or update date' "
                   f"WHEN {days} IS NULL THEN concat('unreadable date: ', {raw}) END"},
        inputs={raw: meta.dated(), days: age_days(parse_iso(meta.dated()), as_of)})


def timeliness(meta: Metadata, as_of: str, half_life_days: float = 365.0) -> Proxy:
    """exp(-age / half_life_days); undated is N/A, an unreadable date scores 0."""
    return _dated(meta, "timeliness", half_life_days, as_of, 0.0, "{}")


def factual_decay_rate(meta: Metadata, as_of: str, half_life_days: float = 365.0) -> Proxy:
    """1 - exp(-age / half_life_days); undated is N/A, an unreadable date scores 1."""
    return _dated(meta, "factual_decay_rate", half_life_days, as_of, 1.0, "(1 - {})")


def poisoning_risk(write_controls: str, crypto: str, source_count: str) -> str:
    """Risk left after access control, signatures and up to five independent sources."""
    return (f"CAST(1.0 - CAST({write_controls} AS INT) * 0.4 - CAST({crypto} AS INT) * 0.3"
            f" - least(0.3, ({source_count} - 1) * 0.075) AS DOUBLE)")


def poisoning_susceptibility(meta: Metadata) -> Proxy:
    w, c = meta.truthy("write_access_controls"), meta.truthy("cryptographic_provenance")
    n = f"CAST({meta.number('source_count', 1)} AS INT)"
    risk = poisoning_risk(w, c, n)
    return Proxy("poisoning_susceptibility", risk, raw_value=risk, details={
        "write_access_controls": w, "cryptographic_provenance": c, "source_count": n})


def adversarial_provenance_risk(meta: Metadata) -> Proxy:
    """User-generated share, scraping breadth and anonymity as one weighted sum."""
    ugc, anon = meta.number("ugc_fraction", 0.0), meta.truthy("anonymous_contributions")
    breadth = f"coalesce({meta.text('scraping_breadth')}, 'narrow')"
    known = f"CAST({sql.choose(breadth, BREADTH, '0.5D')} AS DECIMAL(4, 2))"
    risk = f"({ugc} * 0.5D + CAST({known} * 0.3 AS DOUBLE) + CAST(CAST({anon} AS INT) * 0.2 AS DOUBLE))"
    return Proxy("adversarial_provenance_risk", risk, raw_value=risk, details={
        "ugc_fraction": ugc, "anonymous_contributions": anon, "scraping_breadth": breadth})


def consent_provenance(meta: Metadata) -> Proxy:
    """Declared consent basis less small credits for documents behind it."""
    kind = f"coalesce({meta.text('consent_type')}, 'none')"
    documented = meta.truthy("subject_consent_documented")
    licensed, dua = meta.truthy("license_for_current_use"), meta.truthy("data_use_agreement")
    basis = f"CAST({sql.choose(kind, CONSENT, '1.0D')} AS DECIMAL(4, 2))"
    risk = (f"CAST({basis} - CAST({documented} AS INT) * 0.1"
            f" - CAST({licensed} AS INT) * 0.05 - CAST({dua} AS INT) * 0.05 AS DOUBLE)")
    return Proxy("consent_provenance", risk, raw_value=risk, details={
        "consent_type": kind, "subject_consent_documented": documented,
        "license_present": licensed, "data_use_agreement_present": dua})


def score_catalog(catalog: DataFrame, proxies: Sequence[Proxy], keys: Sequence[str]) -> DataFrame:
    """(keys, ord, axis, name, score, applicable, raw_value, details): one projection."""
    return long_scores(catalog, proxies, keys)


def catalog_relevance(declared: DataFrame, present: DataFrame, keys: Sequence[str] = ("dataset",),
                      column: str = "column") -> DataFrame:
    """(keys, n_declared, n_present, score): share of declared columns a dataset has."""
    have = present.select(*keys, column).distinct().withColumn("__found", F.lit(1))
    both = declared.join(have, [*keys, column], "left")
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_declared"), F.count("__found").alias("n_present"),
        F.avg(F.coalesce("__found", F.lit(0))).alias("score"))


def select_datasets(catalog: DataFrame, key: str, names: Sequence[str] | None = None,
                    where: Mapping[str, Any] | None = None) -> DataFrame:
    """(key, status): catalog rows by name list and field values; an unknown name is an error row."""
    picked = catalog
    for k, v in (where or {}).items():
        picked = picked.where(F.col(k) == F.lit(v))
    if names is None:
        return picked.select(key, F.lit("ok").alias("status"))
    wanted = sql.local_table(catalog.sparkSession, [(n,) for n in names], [key])
    unknown = wanted.join(catalog.select(key), key, "left_anti").select(key, F.lit("unknown").alias("status"))
    known = picked.where(F.col(key).isin(*names)).select(key, F.lit("ok").alias("status"))
    return known.unionByName(unknown)
