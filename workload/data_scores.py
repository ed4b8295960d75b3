"""Proxies that scan data: error, representation, text harm, k-anonymity, NMI."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.functions.text import DUAL_USE_PATTERNS, PII_PATTERNS, TOXIC_TERMS
from slicegauge.operators import duplicates as dup, nmi, quality, rights, safety, shares
from slicegauge.operators.quantiles import approximate_quantiles, exact_quantiles, rank_errors
from . import expected
from .registry import Tables, query, rounded
from . import sqlgen as G

# --- amounts, shares, representation ---------------------------------------


@query("appropriate_amount", """SELECT o_orderstatus, count(*) AS n_rows,
  round(least(1.0, count(*) / 10000.0), 8) AS score, true AS applicable FROM orders GROUP BY o_orderstatus""")
def appropriate_amount(t: Tables) -> DataFrame:
    return quality.appropriate_amount(t.orders, 10_000, ["o_orderstatus"]).selectExpr(
        "o_orderstatus", "CAST(raw_value AS BIGINT) AS n_rows", *rounded("score"), "applicable")


REF_LINE = {"l_returnflag": {"A": 0.3, "N": 0.5, "R": 0.1, "X": 0.1}, "l_linestatus": {"O": 0.6, "F": 0.4}}


@query("representativeness", f"""SELECT l_linenumber, round(1 - tv, 8) + 0.0 AS score, true AS applicable
  FROM ({G.tv_sql('lineitem', REF_LINE, 'l_linenumber')})""")
def representativeness(t: Tables) -> DataFrame:
    return quality.representativeness(t.lineitem, REF_LINE, ["l_linenumber"]).selectExpr(
        "l_linenumber", *rounded("score"), "applicable")


@query("value_shares", """SELECT event_type AS value, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 8) AS share FROM events GROUP BY event_type""")
def value_shares(t: Tables) -> DataFrame:
    return shares.value_shares(t.events, "event_type").selectExpr("value", "n", *rounded("share"))


REF_NATION = {"n_name": {f"NATION_{i}": round(1 / 25, 4) for i in range(25)},
              "c_mktsegment": {"BUILDING": 0.25, "MACHINERY": 0.25, "HOUSEHOLD": 0.5}}
_CUST_REGION = ("(SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey "
                "JOIN region ON n_regionkey = r_regionkey)")


@query("representation_gap", f"""SELECT r_name, round(tv, 8) + 0.0 AS score, true AS applicable
  FROM ({G.tv_sql(_CUST_REGION, REF_NATION, 'r_name')})""")
def representation_gap(t: Tables) -> DataFrame:
    people = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("r_name", "n_name", "c_mktsegment"))
    return rights.demographic_representation_gap(people, list(REF_NATION), REF_NATION, ["r_name"]).selectExpr(
        "r_name", *rounded("score"), "applicable")


# --- errors ------------------------------------------------------------------

# Missing values, repeated rows and outliers arise from the projection itself.
DIRTY = {"nation": "c_nationkey", "segment": "nullif(c_mktsegment, 'MACHINERY')",
         "band": "CASE WHEN c_acctbal >= 0 THEN power(floor(c_acctbal / 500), 5) END",
         "tier": "floor(c_acctbal / 4000)"}
DIRTY_SQL = "dirty AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in DIRTY.items()) + " FROM customer)"


def dirty(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" if c in ("band", "tier") else f"{e} AS {c}"
                                   for c, e in DIRTY.items()])


@query("free_of_error", f"""WITH {DIRTY_SQL} SELECT nation, round(score, 8) + 0.0 AS score, round(missing, 8) + 0.0 AS missing,
  round(dup, 8) + 0.0 AS dup, round(outl, 8) + 0.0 AS outl FROM ({G.error_sql('dirty', ['segment', 'band', 'tier'], ['band', 'tier'], 'nation')})""")
def free_of_error(t: Tables) -> DataFrame:
    parts = "from_json(details, 'missing_rate double, duplicate_rate double, outlier_rate double') AS d"
    return quality.free_of_error(dirty(t), ["nation"]).selectExpr("nation", "score", parts).selectExpr(
        "nation", *rounded("score"), "round(d.missing_rate, 8) AS missing", "round(d.duplicate_rate, 8) AS dup",
        "round(d.outlier_rate, 8) AS outl")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_linestatus", "l_shipdate"]


@query("free_of_error_lineitem", f"""SELECT l_returnflag, round(score, 8) + 0.0 AS score FROM (
  {G.error_sql('lineitem', _LINE, _LINE[:8], 'l_returnflag')})""")
def free_of_error_lineitem(t: Tables) -> DataFrame:
    return quality.free_of_error(t.lineitem, ["l_returnflag"]).selectExpr("l_returnflag", *rounded("score"))


@query("missing_rate", """SELECT event_type, count(*) AS n_rows, count(*) FILTER (user_id < 20) + count(*) FILTER (value < 5) AS n_missing,
  round((count(*) FILTER (user_id < 20) + count(*) FILTER (value < 5)) / (count(*) * 3.0), 8) AS missing_rate FROM events GROUP BY event_type""")
def missing_rate(t: Tables) -> DataFrame:
    holes = t.events.selectExpr("event_type", "CASE WHEN user_id >= 20 THEN user_id END AS user_id",
                                "CASE WHEN value < 5 THEN double('nan') ELSE value END AS value", "ts")
    return dup.missing_rate(holes, ["event_type"]).selectExpr("event_type", "n_rows", "n_missing", *rounded("missing_rate"))


@query("duplicate_rate", """SELECT lang, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
  round(sum(c - 1) / CAST(sum(c) AS DOUBLE), 8) AS duplicate_rate
  FROM (SELECT lang, text, n_chars, count(*) AS c FROM documents GROUP BY ALL) GROUP BY lang""")
def duplicate_rate(t: Tables) -> DataFrame:
    return dup.duplicate_rate(t.documents.select("lang", "text", "n_chars"), ["lang"]).selectExpr(
        "lang", "n_rows", "n_duplicates", *rounded("duplicate_rate"))


_OUT = {"l_quantity": "l_quantity", "l_tax": "l_tax", "steep": "power(l_quantity, 5)"}


@query("iqr_outlier_rate", f"""WITH li AS (SELECT l_returnflag, {', '.join(f'{e} AS {c}' for c, e in _OUT.items())} FROM lineitem)
  SELECT l_returnflag, col AS "column", n, n_out, round(lo, 4) + 0.0 AS lo, round(hi, 4) + 0.0 AS hi, round(share, 8) + 0.0 AS share
  FROM ({G.outlier_sql('li', list(_OUT), 'l_returnflag')})""")
def iqr_outlier_rate(t: Tables) -> DataFrame:
    li = t.lineitem.selectExpr("l_returnflag", *[f"{e} AS {c}" for c, e in _OUT.items()])
    return dup.outlier_shares(li, ["l_returnflag"]).selectExpr(
        "l_returnflag", "column", "n", "n_out", *rounded("lo", "hi", digits=4), *rounded("share"))


@query("exact_quantiles", """SELECT l_returnflag, 'l_extendedprice' AS "column", count(*) AS n, """ + ", ".join(
    f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{i}" for i, p in enumerate((0, .1, .25, .5, .9, .99, 1))) + """
  FROM lineitem GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'l_quantity', count(*), """ + ", ".join(
    f"round(quantile_cont(l_quantity, {p}), 6)" for p in (0, .1, .25, .5, .9, .99, 1)) + " FROM lineitem GROUP BY l_returnflag")
def quantiles(t: Tables) -> DataFrame:
    q = exact_quantiles(t.lineitem, ["l_extendedprice", "l_quantity"], [0, .1, .25, .5, .9, .99, 1], ["l_returnflag"])
    return q.selectExpr("l_returnflag", "column", "n", *[f"round(q[{i}], 6) AS q{i}" for i in range(7)])


_PROBS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@query("approximate_quantiles", "SELECT l_returnflag, c AS \"column\", count(*) AS n, CAST(p AS DOUBLE) AS prob, true AS within FROM lineitem, "
       f"(VALUES ('l_extendedprice'), ('l_quantity')) a(c), (VALUES {', '.join(f'({p})' for p in _PROBS)}) b(p) GROUP BY ALL")
def sketched_quantiles(t: Tables) -> DataFrame:
    """Sketches of every group and column; their true rank errors are measured and must keep to the stated bound."""
    columns = ["l_extendedprice", "l_quantity"]
    q = approximate_quantiles(t.lineitem, columns, _PROBS, ["l_returnflag"], 0.002)
    return rank_errors(t.lineitem, q, columns, _PROBS, ["l_returnflag"]).selectExpr("l_returnflag", "column", "n", "prob", "error <= 0.002 AS within")


# --- texts -------------------------------------------------------------------

def _re(pattern: str, column: str = "text", flags: str = "") -> str:
    return f"regexp_matches({column}, '{pattern}', '{flags or 'c'}')"


_TOX = expected.TOXIC
_PII = "(" + " OR ".join(expected.PII.values()) + ")"
_USABLE = r"regexp_matches(text, '\S')"


def _harm_sql(table: str, by: str) -> str:
    return f"""SELECT {by}, round(greatest(count(*) FILTER ({_TOX}), count(*) FILTER ({_PII})) / CAST(count(*) AS DOUBLE), 8) AS score,
      count(*) AS n_texts, count(*) FILTER ({_TOX}) AS n_toxic, count(*) FILTER ({_PII}) AS n_pii FROM {table} WHERE {_USABLE} GROUP BY {by}"""


def _harm(df: DataFrame, by: str, **options) -> DataFrame:
    out = safety.harm_content_density(df, "text", [by], **options)
    return out.selectExpr(
        by, "score", "applicable", "from_json(raw_value, 'toxic_fraction double, pii_fraction double') AS r",
        "from_json(details, 'sample_size_used bigint') AS d").selectExpr(
        by, *rounded("score"), "d.sample_size_used AS n_texts",
        "CAST(round(r.toxic_fraction * d.sample_size_used) AS BIGINT) AS n_toxic",
        "CAST(round(r.pii_fraction * d.sample_size_used) AS BIGINT) AS n_pii")


@query("harm_content_density", _harm_sql("documents", "lang"))
def harm_content_density(t: Tables) -> DataFrame:
    return _harm(t.documents, "lang")


@query("harm_by_role", _harm_sql("conversations", "role"))
def harm_by_role(t: Tables) -> DataFrame:
    return _harm(t.conversations, "role")


_KEY = G.draw("'42'", "'texts'", "CAST(doc_id AS VARCHAR)")


@query("harm_density_sampled", _harm_sql(
    f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) AS r FROM documents "
    f"WHERE {_USABLE}) WHERE r <= 100)", "lang"))
def harm_density_sampled(t: Tables) -> DataFrame:
    return _harm(t.documents, "lang", sample_size=100, key="doc_id")


@query("pii_flags", "SELECT lang, count(*) AS n_texts, " + ", ".join(
    f"count(*) FILTER ({p}) AS n_{k}" for k, p in expected.PII.items()) + f", count(*) FILTER ({_PII}) AS n_any FROM documents WHERE {_USABLE} GROUP BY lang")
def pii_flags(t: Tables) -> DataFrame:
    return safety.text_flags(t.documents, "text", PII_PATTERNS, ["lang"])


@query("toxicity_lexicon", f"SELECT source, count(*) AS n_texts, count(*) FILTER ({_TOX}) AS n_lexicon, count(*) FILTER ({_TOX}) AS n_any "
                           f"FROM documents WHERE {_USABLE} GROUP BY source")
def toxicity_lexicon(t: Tables) -> DataFrame:
    return safety.text_flags(t.documents, "text", {"lexicon": TOXIC_TERMS}, ["source"], ignore_case=True)


@query("toxicity_threshold_rate", f"""SELECT lang, count(*) AS n_texts,
  round(greatest(count(*) FILTER (toxic >= 0.7), count(*) FILTER ({_PII})) / CAST(count(*) AS DOUBLE), 8) AS score,
  count(*) FILTER (toxic >= 0.7) AS n_toxic, count(*) FILTER ({_PII}) AS n_pii FROM documents JOIN labels USING (doc_id) WHERE {_USABLE} GROUP BY lang""")
def toxicity_threshold_rate(t: Tables) -> DataFrame:
    scored = t.documents.join(t.labels, "doc_id")
    return _harm(scored, "lang", classifier=["toxic"])


OWN_TERMS = {"a": [r"\bthing\b", r"\boning\b"], "b": [r"\bering\b"]}


def _dual_sql(patterns: dict, by: str) -> str:
    hit = {k: "(" + " OR ".join(_re(p, flags="i") for p in ps) + ")" for k, ps in patterns.items()}
    per = ", ".join(f"count(*) FILTER ({h}) AS {k}" for k, h in hit.items())
    any_ = " OR ".join(hit.values())
    return (f"SELECT {by}, count(*) FILTER ({any_}) AS flagged, {per}, round(count(*) FILTER ({any_}) / CAST(count(*) AS DOUBLE), 8) AS score "
            f"FROM documents WHERE {_USABLE} GROUP BY {by}")


def _dual(t: Tables, patterns: dict, by: str) -> DataFrame:
    out = safety.physical_harm_enablement_density(t.documents, "text", [by], patterns=patterns)
    schema = "flagged_count bigint, per_category_hits struct<" + ", ".join(f"{k}: bigint" for k in patterns) + ">"
    return out.selectExpr(by, "score", f"from_json(details, '{schema}') AS d").selectExpr(
        by, *rounded("score"), "d.flagged_count AS flagged", *[f"d.per_category_hits.{k} AS {k}" for k in patterns])


@query("dual_use_density", _dual_sql(OWN_TERMS, "source"))
def dual_use_density(t: Tables) -> DataFrame:
    return _dual(t, OWN_TERMS, "source")


@query("dual_use_density_stock", _dual_sql(expected.DUAL_USE, "lang"))
def dual_use_density_stock(t: Tables) -> DataFrame:
    return _dual(t, DUAL_USE_PATTERNS, "lang")


EDGE = [{"name": "deep_discount", "filter": "l_discount >= 0.1 AND l_quantity > 45", "min_count": 20},
        {"name": "untaxed_return", "filter": "l_tax = 0 AND l_returnflag = 'R'", "min_count": 1},
        {"name": "late", "filter": "l_shipdate > timestamp'2030-01-01 00:00:00'"},
        {"name": "bad_cast", "filter": "CAST(l_returnflag AS INT) > 1"},
        {"name": "zero_division", "filter": "l_quantity / l_tax > 2000"},
        {"name": "mixed_text", "filter": "CAST(concat(IF(l_tax = 0, 'x', ''), l_quantity) AS DOUBLE) >= 50", "min_count": 5},
        {"name": "broken", "filter": "no_such_column > 1"}]


@query("edge_case_coverage", """SELECT l_linenumber, round(1 - (CAST(count(*) FILTER (l_discount >= 0.1 AND l_quantity > 45) >= 20 AS INT)
    + CAST(count(*) FILTER (l_tax = 0 AND l_returnflag = 'R') >= 1 AS INT)
    + CAST(count(*) FILTER (l_shipdate > TIMESTAMP '2030-01-01') >= 1 AS INT)
    + CAST(count(*) FILTER (TRY_CAST(l_returnflag AS INT) > 1) >= 1 AS INT)
    + CAST(count(*) FILTER (l_quantity / nullif(l_tax, 0) > 2000) >= 1 AS INT)
    + CAST(count(*) FILTER (l_tax <> 0 AND l_quantity >= 50) >= 5 AS INT)) / 7.0, 8) AS score, true AS applicable
  FROM lineitem GROUP BY l_linenumber""")
def edge_case_coverage(t: Tables) -> DataFrame:
    return safety.edge_case_coverage(t.lineitem, EDGE, True, ["l_linenumber"]).selectExpr(
        "l_linenumber", *rounded("score"), "applicable")


# --- rights ------------------------------------------------------------------

_QI = ["o_orderpriority", "y", "m"]
_OQI = "(SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)"


@query("reidentification_risk", f"SELECT o_orderstatus, k, n_classes, round(risk, 8) AS score FROM ({G.kanon_sql(_OQI, _QI, 'o_orderstatus')})")
def reidentification_risk(t: Tables) -> DataFrame:
    o = t.orders.selectExpr("o_orderstatus", "nullif(o_orderpriority, '5-LOW') AS o_orderpriority",
                            "year(o_orderdate) AS y", "month(o_orderdate) AS m")
    return rights.reidentification_risk(o, _QI, ["o_orderstatus"]).selectExpr(
        "o_orderstatus", "CAST(raw_value AS BIGINT) AS k",
        "from_json(details, 'n_classes bigint').n_classes AS n_classes", *rounded("score"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NMI_LINE = "(SELECT CAST(year(l_shipdate) AS INT) AS y, CASE WHEN l_tax > 0.01 THEN l_tax END AS l_tax, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus FROM lineitem)"


def _nmi_input(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("year(l_shipdate) AS y", "CASE WHEN l_tax > 0.01 THEN l_tax END AS l_tax", "l_quantity",
                                 "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


_NMI_SQL = G.nmi_sql(_NMI_LINE, _NUM, ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"], "y")


@query("nmi_pairs", f"SELECT y, feature, protected, n, round(nmi, 8) + 0.0 AS nmi FROM ({_NMI_SQL})")
def nmi_pairs(t: Tables) -> DataFrame:
    return nmi.nmi_pairs(_nmi_input(t), _NUM, ["l_returnflag", "l_linestatus"], ["y"]).selectExpr(
        "y", "feature", "protected", "n", *rounded("nmi"))


@query("inferential_harm", f"""SELECT y, round(count(*) FILTER (best >= 0.002) / 4.0, 8) AS score, true AS applicable FROM (
  SELECT y, feature, max(nmi) AS best FROM ({_NMI_SQL}) GROUP BY ALL) GROUP BY y""")
def inferential_harm(t: Tables) -> DataFrame:
    out = rights.inferential_harm_potential(_nmi_input(t), ["l_returnflag", "l_linestatus"], ["y"], 0.002)
    return out.selectExpr("y", *rounded("score"), "applicable")


@query("entropy", " UNION ALL ".join(f"""SELECT y, '{c}' AS "column", CAST(sum(c) AS BIGINT) AS n,
   round(-sum(p * ln(p)), 8) + 0.0 AS entropy FROM (SELECT *, c / CAST(sum(c) OVER (PARTITION BY y) AS DOUBLE) AS p FROM (
   SELECT CAST(year(l_shipdate) AS INT) AS y, {c}, count(*) AS c FROM lineitem GROUP BY ALL)) GROUP BY y""" for c in ("l_returnflag", "l_suppkey")))
def entropy(t: Tables) -> DataFrame:
    li = t.lineitem.selectExpr("year(l_shipdate) AS y", "l_returnflag", "l_suppkey")
    return shares.entropy(li, ["l_returnflag", "l_suppkey"], ["y"]).selectExpr("y", "column", "n", *rounded("entropy"))


@query("mutual_information", """WITH j AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS c FROM orders GROUP BY ALL),
  p AS (SELECT *, c / CAST(sum(c) OVER () AS DOUBLE) AS p, sum(c) OVER (PARTITION BY x) / CAST(sum(c) OVER () AS DOUBLE) AS px,
        sum(c) OVER (PARTITION BY y) / CAST(sum(c) OVER () AS DOUBLE) AS py FROM j)
  SELECT 'o_orderstatus' AS feature, 'o_orderpriority' AS protected, CAST(sum(c) AS BIGINT) AS n,
         round(sum(p * ln(p / (px * py))), 8) + 0.0 AS mi FROM p""")
def mutual_information(t: Tables) -> DataFrame:
    return nmi.nmi_pairs(t.orders, ["o_orderstatus"], ["o_orderpriority"]).selectExpr("feature", "protected", "n", *rounded("mi"))
