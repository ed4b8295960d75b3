"""Documentation proxies over a catalog with one row per supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.operators import metadata as md
from slicegauge.operators.composite import (
    by_application, composites, passes_threshold, scores_wide, slice_grid, uniform_quality)
from slicegauge.operators.safety import source_counts
from slicegauge.functions import dates, sql as S
from slicegauge.schema import ORDER, AXIS
from . import expected
from .registry import AS_OF, Tables, query, rounded

K = "s_suppkey"

# The same text is an expression in Spark SQL and in the oracle's dialect.
CATALOG = {
    "dataset": "s_name",
    "source_identifier": f"CASE WHEN {K} % 3 <> 0 THEN s_name ELSE '' END",
    "collection_methodology": f"CASE WHEN {K} % 4 <> 0 THEN 'survey' END",
    "license": f"CASE WHEN {K} % 5 <> 0 THEN 'CC-BY' END",
    "institutional_pedigree": f"{K} % 2 = 0",
    "versioning": f"{K} % 3 = 1",
    "checksum_published": f"{K} % 2 = 1",
    "signed_releases": f"{K} % 7 = 0",
    "access_logging": f"{K} % 5 = 1",
    "chain_of_custody": f"CASE WHEN {K} % 11 <> 0 THEN {K} % 3 = 0 END",
    "content_type": f"CASE {K} % 9 WHEN 0 THEN 'measurement' WHEN 1 THEN 'transactional' WHEN 2 THEN 'reference' "
                    "WHEN 3 THEN 'mixed' WHEN 4 THEN 'opinion' WHEN 5 THEN 'review' "
                    "WHEN 6 THEN 'subjective_survey' WHEN 7 THEN 'unknown_kind' END",
    "data_collection_end": f"CASE WHEN {K} % 13 = 0 THEN '' WHEN {K} % 17 = 0 THEN 'not-a-date' "
                           f"WHEN {K} % 6 <> 0 THEN CAST(date '2015-01-01' + CAST(({K} * 37) % 3000 AS INT) AS VARCHAR(10)) END",
    "last_updated": f"CASE WHEN {K} % 13 = 0 THEN '2021-03-04' END",
    "write_access_controls": f"{K} % 2 = 0",
    "cryptographic_provenance": f"{K} % 3 = 0",
    "source_count": f"CAST({K} % 8 AS INT)",
    "ugc_fraction": f"CAST({K} % 11 AS DOUBLE) / 10",
    "anonymous_contributions": f"{K} % 4 = 1",
    "scraping_breadth": f"CASE {K} % 6 WHEN 0 THEN 'narrow' WHEN 1 THEN 'medium' WHEN 2 THEN 'broad' "
                        "WHEN 3 THEN 'web_scale' WHEN 4 THEN 'odd' END",
    "consent_type": f"CASE {K} % 7 WHEN 0 THEN 'opt_in' WHEN 1 THEN 'opt_out' WHEN 2 THEN 'inferred' "
                    "WHEN 3 THEN 'scraped' WHEN 4 THEN 'none' WHEN 5 THEN 'other' END",
    "subject_consent_documented": f"{K} % 2 = 0",
    "license_for_current_use": f"CASE WHEN {K} % 3 <> 0 THEN 'CC-BY' END",
    "data_use_agreement": f"{K} % 5 = 0",
    "subject_access_process": f"{K} % 2 = 0",
    "correction_process": f"{K} % 3 = 0",
    "deletion_process": f"{K} % 4 = 0",
    "contact_for_subject_rights": f"{K} % 5 = 0",
}
CAT_SQL = "cat AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in CATALOG.items()) + " FROM supplier)"


def catalog(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(*[f"{e} AS {c}" for c, e in CATALOG.items()])


def _has(*fields: str) -> str:
    """Oracle: number of filled fields."""
    strings = {"source_identifier", "collection_methodology", "license", "license_for_current_use"}
    return " + ".join(
        f"CAST(coalesce({f} <> '', false) AS INT)" if f in strings else f"CAST(coalesce({f}, false) AS INT)"
        for f in fields)


_RAW = "coalesce(nullif(data_collection_end, ''), nullif(last_updated, ''))"
# greatest() skips NULLs in both dialects: an unreadable date must stay NULL
_AGE = (f"CASE WHEN TRY_CAST({_RAW} AS TIMESTAMP) IS NOT NULL THEN greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') "
        f"- epoch_us(TRY_CAST({_RAW} AS TIMESTAMP))) / 86400e6) END")


# name -> (score, applicable) in the oracle's dialect, over `cat`
CAT_SCORES = {
    "source_trustworthiness": (f"({_has(*expected.TRUST)}) / 5.0", "true"),
    "objectivity": (expected.OBJECTIVITY, "content_type IS NOT NULL"),
    "timeliness": (f"CASE WHEN {_RAW} IS NULL THEN 0.5 ELSE coalesce(exp(-({_AGE}) / 365.0), 0.0) END",
                   f"{_RAW} IS NOT NULL"),
    "source_security": (f"({_has(*expected.SECURITY)}) / 4.0", "true"),
    "poisoning_susceptibility": (
        "greatest(0.0, least(1.0, 1.0 - CAST(write_access_controls AS INT) * 0.4 - CAST(cryptographic_provenance AS INT)"
        " * 0.3 - least(0.3, (source_count - 1) * 0.075)))", "true"),
    "adversarial_provenance_risk": (
        "0.5 * ugc_fraction + 0.3 * " + expected.BREADTH +
        " + 0.2 * CAST(anonymous_contributions AS INT)", "true"),
    "factual_decay_rate": (f"CASE WHEN {_RAW} IS NULL THEN 0.5 ELSE coalesce(1 - exp(-({_AGE}) / 365.0), 1.0) END",
                           f"{_RAW} IS NOT NULL"),
    "consent_provenance": (
        f"greatest(0.0, {expected.CONSENT} - 0.1 * ({_has('subject_consent_documented')})"
        f" - 0.05 * ({_has('license_for_current_use')}) - 0.05 * ({_has('data_use_agreement')}))", "true"),
    "contestability": (f"1 - ({_has(*expected.CONTEST)}) / 4.0", "true"),
}


def _proxies(meta: md.Metadata) -> dict:
    return {p.name: p for p in (
        md.source_trustworthiness(meta), md.objectivity(meta), md.timeliness(meta, AS_OF),
        md.source_security(meta), md.poisoning_susceptibility(meta), md.adversarial_provenance_risk(meta),
        md.factual_decay_rate(meta, AS_OF), md.consent_provenance(meta), md.contestability(meta))}


def _register(name: str):
    score, ok = CAT_SCORES[name]

    @query(name, f"WITH {CAT_SQL} SELECT dataset, round(CAST({score} AS DOUBLE), 8) + 0.0 AS score, "
                 f"{ok} AS applicable FROM cat")
    def run(t: Tables) -> DataFrame:
        cat = catalog(t)
        long = md.score_catalog(cat, [_proxies(md.Metadata(cat))[name]], ["dataset"])
        return long.selectExpr("dataset", *rounded("score"), "applicable")


for _name in CAT_SCORES:
    _register(_name)


def catalog_scores(t: Tables) -> DataFrame:
    """All documentation proxies of all datasets, long."""
    cat = catalog(t)
    return md.score_catalog(cat, list(_proxies(md.Metadata(cat)).values()), ["dataset"])


LONG_SQL = CAT_SQL + ", sc AS (" + " UNION ALL ".join(
    f"SELECT dataset, {ORDER[n]} AS ord, '{AXIS[n]}' AS axis, '{n}' AS name, CAST({s} AS DOUBLE) AS score, "
    f"{ok} AS applicable FROM cat" for n, (s, ok) in CAT_SCORES.items()) + ")"


def weight_sql(app: str) -> str:
    return expected.WEIGHTS[app]


def composite_sql(app: str, keys: str, source: str = "sc") -> str:
    """Q, S, R per key from a long score relation."""
    w = f"CAST({weight_sql(app)} AS DOUBLE)"
    return f"""SELECT {keys},
      coalesce(sum(CASE WHEN applicable AND axis = 'quality' THEN {w} * score END)
               / sum(CASE WHEN applicable AND axis = 'quality' THEN {w} END), 0.0) AS quality,
      avg(CASE WHEN applicable AND axis = 'safety' THEN score END) AS safety,
      avg(CASE WHEN applicable AND axis = 'rights' THEN score END) AS rights
      FROM {source} GROUP BY {keys}"""


_QSR = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in ("quality", "safety", "rights"))


@query("catalog_scores_long", f"WITH {LONG_SQL} SELECT dataset, CAST(ord AS INT) AS ord, axis, name, "
                              "round(score, 8) + 0.0 AS score, applicable FROM sc")
def catalog_scores_long(t: Tables) -> DataFrame:
    return catalog_scores(t).selectExpr("dataset", "ord", "axis", "name", *rounded("score"), "applicable")


@query("composite_scores", f"WITH {LONG_SQL} SELECT dataset, {_QSR} FROM ({composite_sql('ML', 'dataset')})")
def composite_scores(t: Tables) -> DataFrame:
    return composites(catalog_scores(t), "ML", ["dataset"]).selectExpr(
        "dataset", *rounded("quality", "safety", "rights"))


@query("excluded_for_na", f"""WITH {LONG_SQL} SELECT dataset,
  coalesce(string_agg(CASE WHEN NOT applicable THEN name END, ',' ORDER BY ord), '') AS excluded,
  count(*) FILTER (applicable) AS n_applicable FROM sc GROUP BY dataset""")
def excluded_for_na(t: Tables) -> DataFrame:
    return composites(catalog_scores(t), "ML", ["dataset"]).selectExpr(
        "dataset", "array_join(excluded_for_na, ',') AS excluded",
        "CAST(size(filter(breakdown, b -> b.applicable)) AS BIGINT) AS n_applicable")


@query("deployment_gate", f"""WITH {LONG_SQL}, c AS ({composite_sql('ML', 'dataset')})
  SELECT dataset, quality >= 0.5 AND coalesce(safety <= 0.6, true) AND coalesce(rights <= 0.6, true) AS passes,
         quality >= 0.7 AND coalesce(safety <= 0.2, true) AND coalesce(rights <= 0.2, true) AS passes_strict FROM c""")
def deployment_gate(t: Tables) -> DataFrame:
    c = composites(catalog_scores(t), "ML", ["dataset"])
    return c.select("dataset", passes_threshold(0.5, 0.6, 0.6).alias("passes"),
                    passes_threshold().alias("passes_strict"))


@query("uniform_q", f"""WITH {LONG_SQL} SELECT dataset,
  round(avg(CASE WHEN applicable THEN score END), 8) + 0.0 AS q_uniform FROM sc WHERE axis = 'quality' GROUP BY dataset""")
def uniform_q(t: Tables) -> DataFrame:
    return uniform_quality(catalog_scores(t), ["dataset"]).selectExpr("dataset", *rounded("q_uniform"))


@query("q_by_application", f"WITH {LONG_SQL} SELECT dataset, application, {_QSR} FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS application, * FROM ({composite_sql(a, 'dataset')})" for a in expected.WEIGHTS) + ")")
def q_by_application(t: Tables) -> DataFrame:
    return by_application(catalog_scores(t), ["dataset"]).selectExpr(
        "dataset", "application", *rounded("quality", "safety", "rights"))


@query("scores_wide", f"WITH {LONG_SQL} SELECT dataset, " + ", ".join(
    f"round(max(CASE WHEN name = '{n}' AND applicable THEN score END), 8) + 0.0 AS {n}" for n in CAT_SCORES)
    + " FROM sc GROUP BY dataset")
def wide(t: Tables) -> DataFrame:
    out = scores_wide(catalog_scores(t), ["dataset"], list(CAT_SCORES))
    return out.selectExpr("dataset", *rounded(*CAT_SCORES))


def catalog_slices(t: Tables) -> DataFrame:
    """Composite per (dataset = region, slice = supplier)."""
    region = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("s_name").alias("slice"), F.col("r_name").alias("region")))
    c = composites(catalog_scores(t), "ML", ["dataset"]).withColumnRenamed("dataset", "slice")
    return c.join(region, "slice").selectExpr("region AS dataset", "slice", "quality AS Q", "safety AS S", "rights AS R")


SLICES_SQL = f"""{LONG_SQL}, sl AS (SELECT r_name AS dataset, s_name AS slice, quality AS Q, safety AS S, rights AS R
  FROM ({composite_sql('ML', 'dataset')}) c JOIN supplier ON s_name = c.dataset
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("slice_summary", f"WITH {SLICES_SQL} SELECT dataset, slice, round(Q, 8) + 0.0 AS Q, round(S, 8) + 0.0 AS S, "
                        "round(R, 8) + 0.0 AS R FROM sl")
def slice_summary(t: Tables) -> DataFrame:
    return catalog_slices(t).selectExpr("dataset", "slice", *rounded("Q", "S", "R"))


@query("slice_grid", f"WITH {SLICES_SQL} SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY slice) - 1 AS INT) AS idx, "
                     "round(Q, 8) + 0.0 AS Q FROM sl")
def grid(t: Tables) -> DataFrame:
    return slice_grid(catalog_slices(t), "dataset", "slice", "Q").selectExpr("dataset", "idx", *rounded("Q"))


@query("relevance", """WITH present(dataset, col) AS (
    SELECT 'customer', c FROM (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS c)
    UNION ALL SELECT 'orders', c FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS c)),
  declared AS (SELECT DISTINCT m.dataset, f.col FROM (SELECT c_mktsegment AS seg, 'customer' AS dataset FROM customer
      UNION ALL SELECT o_orderpriority, 'orders' FROM orders) m,
    (VALUES ('BUILDING', 'c_acctbal'), ('MACHINERY', 'c_mktsegment'), ('HOUSEHOLD', 'age'), ('AUTOMOBILE', 'c_phone'),
            ('1-URGENT', 'o_totalprice'), ('5-LOW', 'o_clerk'), ('2-HIGH', 'o_custkey')) f(seg, col) WHERE m.seg = f.seg)
  SELECT d.dataset, count(*) AS n_declared, count(p.col) AS n_present,
         round(avg(CAST(p.col IS NOT NULL AS INT)), 8) + 0.0 AS score
  FROM declared d LEFT JOIN present p ON d.dataset = p.dataset AND d.col = p.col GROUP BY d.dataset""")
def relevance(t: Tables) -> DataFrame:
    """Declared columns follow from the segments found in the data; schemas are the tables' own."""
    needs = {"BUILDING": "c_acctbal", "MACHINERY": "c_mktsegment", "HOUSEHOLD": "age", "AUTOMOBILE": "c_phone",
             "1-URGENT": "o_totalprice", "5-LOW": "o_clerk", "2-HIGH": "o_custkey"}
    seen = (t.customer.selectExpr("'customer' AS dataset", "c_mktsegment AS seg")
            .unionAll(t.orders.selectExpr("'orders' AS dataset", "o_orderpriority AS seg")))
    declared = (seen.withColumn("column", F.expr(S.choose("seg", needs, "NULL")))
                .where("column IS NOT NULL").select("dataset", "column").distinct())
    listing = [(n, c) for n in ("customer", "orders") for c in getattr(t, n).columns]
    present = S.local_table(t.spark, listing, ["dataset", "column"])
    return md.catalog_relevance(declared, present).selectExpr("dataset", "n_declared", "n_present", *rounded("score"))


@query("row_timeliness", f"""SELECT o_orderpriority, count(*) AS n,
  round(avg(exp(-greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400e6) / 3650.0)), 8) AS score
  FROM orders GROUP BY o_orderpriority""")
def row_timeliness(t: Tables) -> DataFrame:
    score = dates.decay(dates.age_days("o_orderdate", AS_OF), 3650.0)
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.expr(f"round(avg({score}), 8)").alias("score"))


@query("poisoning_by_source", """SELECT lang, count(DISTINCT source) AS source_count,
  round(CAST(greatest(0.0, least(1.0, 1.0 - 0.4 - least(0.3, (count(DISTINCT source) - 1) * 0.075))) AS DOUBLE), 8) AS score
  FROM documents GROUP BY lang""")
def poisoning_by_source(t: Tables) -> DataFrame:
    n = source_counts(t.documents, "source", ["lang"])
    risk = md.poisoning_risk("true", "false", "source_count")
    return n.selectExpr("lang", "source_count", f"round({S.clamp01(risk)}, 8) AS score")


@query("catalog_select", f"""WITH {CAT_SQL}
  SELECT dataset, 'ok' AS status FROM cat WHERE content_type = 'review' AND write_access_controls""")
def catalog_select(t: Tables) -> DataFrame:
    return md.select_datasets(catalog(t), "dataset", where={"content_type": "review", "write_access_controls": True})
