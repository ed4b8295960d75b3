"""Accuracy and fairness metrics of predictions derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.functions.text import TOXIC_TERMS, matches
from slicegauge.operators import fairness as fm
from . import expected
from .registry import Tables, query, rounded

BY = ["slice", "model_family", "seed"]
PROT = ["priority", "status"]

# Large: did a line get returned, predicted by its discount.
PRED_SQL = """pred AS (SELECT o_orderstatus AS slice, CASE WHEN l_tax < 0.04 THEN 'low' ELSE 'high' END AS model_family,
  CAST(l_linenumber AS INT) AS seed, CAST(l_returnflag = 'R' AS INT) AS y_true, CAST(l_discount >= 0.05 AS INT) AS y_pred,
  nullif(o_orderpriority, '5-LOW') AS priority, l_linestatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def predictions(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_orderstatus AS slice", "CASE WHEN l_tax < 0.04 THEN 'low' ELSE 'high' END AS model_family",
        "l_linenumber AS seed", "CAST(l_returnflag = 'R' AS INT) AS y_true", "CAST(l_discount >= 0.05 AS INT) AS y_pred",
        "nullif(o_orderpriority, '5-LOW') AS prot__priority", "l_linestatus AS prot__status")


def groups_sql(prot: list[str], by: str, pred: str = "pred") -> str:
    return " UNION ALL ".join(f"""SELECT {by}, {i} AS ao, '{p}' AS attribute, {p} AS g, count(*) AS n,
      avg(CAST(y_true = y_pred AS INT)) AS acc, avg(CAST(y_true <> y_pred AS INT)) AS err, avg(y_pred) AS pr,
      avg(y_pred) FILTER (y_true = 1) AS tpr, avg(y_pred) FILTER (y_true = 0) AS fpr FROM {pred} GROUP BY ALL"""
                              for i, p in enumerate(prot))


_B = "slice, model_family, seed"
_GR = f"WITH {PRED_SQL}, gr AS ({groups_sql(PROT, _B)})"

# Small: labelled toxicity, predicted by the word list.
DOC_SQL = f"""pred AS (SELECT source AS slice, toxic AS y_true, CAST({expected.TOXIC} AS INT) AS y_pred,
  lang FROM documents JOIN labels USING (doc_id))"""


def doc_predictions(t: Tables) -> DataFrame:
    hit = matches(F.col("text"), TOXIC_TERMS, True).cast("int")
    return t.documents.join(t.labels, "doc_id").select(
        F.col("source").alias("slice"), F.col("toxic").alias("y_true"), hit.alias("y_pred"), F.col("lang").alias("prot__lang"))


@query("overall_accuracy", f"WITH {PRED_SQL} SELECT {_B}, count(*) AS n_test, round(avg(CAST(y_true = y_pred AS INT)), 8) AS accuracy FROM pred GROUP BY ALL")
def overall_accuracy(t: Tables) -> DataFrame:
    return fm.overall_accuracy(predictions(t), BY).selectExpr(*BY, "n_test", *rounded("accuracy"))


@query("subgroup_accuracy", f"{_GR} SELECT {_B}, attribute, coalesce(g, 'nan') AS \"group\", n, round(acc, 8) AS accuracy FROM gr")
def subgroup_accuracy(t: Tables) -> DataFrame:
    return fm.subgroup_accuracy(predictions(t), PROT, BY).selectExpr(*BY, "attribute", "`group`", "n", *rounded("accuracy"))


_WORST = f"""SELECT {_B}, round(acc, 8) AS worst_subgroup_accuracy, attribute AS worst_subgroup_attr, coalesce(g, 'nan') AS worst_subgroup_group
  FROM gr QUALIFY row_number() OVER (PARTITION BY {_B} ORDER BY acc, ao, g IS NULL, g) = 1"""


@query("worst_subgroup", f"{_GR} {_WORST}")
def worst_subgroup(t: Tables) -> DataFrame:
    g = fm.subgroups(predictions(t), PROT, BY)
    return fm.worst_subgroup(g, BY).selectExpr(*BY, *rounded("worst_subgroup_accuracy"), "worst_subgroup_attr", "worst_subgroup_group")


def gaps_sql(by: str) -> str:
    both = "tpr IS NOT NULL AND fpr IS NOT NULL"
    return f"""SELECT {by}, attribute, count(*) AS n_groups, CASE WHEN count(*) >= 2 THEN max(pr) - min(pr) END AS dpd,
      CASE WHEN count(*) FILTER ({both}) >= 2 THEN greatest(max(tpr) FILTER ({both}) - min(tpr) FILTER ({both}),
        max(fpr) FILTER ({both}) - min(fpr) FILTER ({both})) END AS eod FROM gr GROUP BY ALL"""


@query("demographic_parity_diff", f"{_GR} SELECT {_B}, attribute, n_groups, round(dpd, 8) + 0.0 AS dpd FROM ({gaps_sql(_B)})")
def demographic_parity_diff(t: Tables) -> DataFrame:
    return fm.demographic_parity_difference(predictions(t), PROT, BY).selectExpr(*BY, "attribute", "n_groups", *rounded("dpd"))


@query("equalized_odds_diff", f"{_GR} SELECT {_B}, attribute, n_groups, round(eod, 8) + 0.0 AS eod FROM ({gaps_sql(_B)})")
def equalized_odds_diff(t: Tables) -> DataFrame:
    return fm.equalized_odds_difference(predictions(t), PROT, BY).selectExpr(*BY, "attribute", "n_groups", *rounded("eod"))


@query("equalized_odds_diff_docs", f"WITH {DOC_SQL}, gr AS ({groups_sql(['lang'], 'slice')}) "
                                   f"SELECT slice, attribute, n_groups, round(eod, 8) + 0.0 AS eod FROM ({gaps_sql('slice')})")
def equalized_odds_diff_docs(t: Tables) -> DataFrame:
    return fm.equalized_odds_difference(doc_predictions(t), ["lang"], ["slice"]).selectExpr("slice", "attribute", "n_groups", *rounded("eod"))


@query("subgroup_error_gap", f"{_GR} SELECT {_B}, round(max(err) - min(err), 8) + 0.0 AS worst_subgroup_error_gap FROM gr GROUP BY ALL")
def subgroup_error_gap(t: Tables) -> DataFrame:
    return fm.subgroup_error_gap(predictions(t), PROT, BY).selectExpr(*BY, *rounded("worst_subgroup_error_gap"))


_SUMMARY = f"""SELECT *, (SELECT max(err) - min(err) FROM gr WHERE gr.slice = s.slice AND gr.model_family = s.model_family AND gr.seed = s.seed) AS gap
  FROM (SELECT {_B}, max(dpd) AS dpd_worst, max(eod) AS eod_worst FROM ({gaps_sql(_B)}) GROUP BY ALL) s"""


@query("fairness_summary", f"{_GR} SELECT {_B}, round(dpd_worst, 8) + 0.0 AS dpd_worst, round(eod_worst, 8) + 0.0 AS eod_worst, "
                           f"round(gap, 8) + 0.0 AS worst_subgroup_error_gap FROM ({_SUMMARY})")
def fairness_summary(t: Tables) -> DataFrame:
    return fm.fairness_summary(predictions(t), PROT, BY).selectExpr(*BY, *rounded("dpd_worst", "eod_worst", "worst_subgroup_error_gap"))


_SCORES = ("(SELECT o_orderstatus AS slice, avg(o_totalprice) / 500000 AS Q, CASE WHEN o_orderstatus <> 'P' THEN count(*) / 1000000.0 END AS R "
           "FROM orders GROUP BY 1)")


@query("run_metrics", f"""{_GR}, w AS ({_WORST}), s AS ({_SUMMARY}), a AS (SELECT {_B}, count(*) AS n_test,
   avg(CAST(y_true = y_pred AS INT)) AS accuracy FROM pred GROUP BY ALL)
  SELECT a.slice, a.model_family, a.seed, n_test, round(accuracy, 8) AS accuracy, worst_subgroup_accuracy, worst_subgroup_attr, worst_subgroup_group,
   round(dpd_worst, 8) + 0.0 AS dpd_worst, round(eod_worst, 8) + 0.0 AS eod_worst, round(gap, 8) + 0.0 AS worst_subgroup_error_gap,
   round(Q, 8) AS Q, round(CAST(R AS DOUBLE), 8) AS R
  FROM a JOIN w USING (slice, model_family, seed) JOIN s USING (slice, model_family, seed) LEFT JOIN {_SCORES} sc ON a.slice = sc.slice""")
def run_metrics(t: Tables) -> DataFrame:
    scores = t.orders.groupBy(F.col("o_orderstatus").alias("slice")).agg(
        F.expr("avg(o_totalprice) / 500000").alias("Q"),
        F.expr("IF(first(o_orderstatus) <> 'P', count(*) / 1000000.0D, NULL)").alias("R"))
    m = fm.with_scores(fm.run_metrics(predictions(t), PROT, BY), scores, ["slice"])
    return m.selectExpr(*BY, "n_test", "worst_subgroup_attr", "worst_subgroup_group", *rounded(
        "accuracy", "worst_subgroup_accuracy", "dpd_worst", "eod_worst", "worst_subgroup_error_gap", "Q", "R"))


@query("run_metrics_unprotected", f"""WITH {PRED_SQL} SELECT {_B}, count(*) AS n_test, round(avg(CAST(y_true = y_pred AS INT)), 8) AS accuracy,
  CAST(NULL AS DOUBLE) AS worst_subgroup_accuracy, CAST(NULL AS VARCHAR) AS worst_subgroup_attr, CAST(NULL AS DOUBLE) AS dpd_worst,
  CAST(NULL AS DOUBLE) AS worst_subgroup_error_gap FROM pred GROUP BY ALL""")
def run_metrics_unprotected(t: Tables) -> DataFrame:
    """A dataset without protected attributes keeps its accuracy."""
    return fm.run_metrics(predictions(t), [], BY).select(*BY, "n_test", F.expr("round(accuracy, 8) AS accuracy"), "worst_subgroup_accuracy",
                                                         "worst_subgroup_attr", "dpd_worst", "worst_subgroup_error_gap")


@query("fairness_absent_attribute", f"""{_GR} SELECT {_B}, attribute, n_groups, round(dpd, 8) + 0.0 AS dpd, round(eod, 8) + 0.0 AS eod FROM ({gaps_sql(_B)})
  UNION ALL SELECT DISTINCT {_B}, 'religion', 0, NULL, NULL FROM pred""")
def fairness_absent_attribute(t: Tables) -> DataFrame:
    """An attribute without a column is a row of NULLs beside those that have one."""
    g = fm.attribute_gaps(fm.subgroups(predictions(t), [*PROT, "religion"], BY), BY)
    return g.selectExpr(*BY, "attribute", "n_groups", *rounded("dpd", "eod"))
