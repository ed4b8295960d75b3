"""Statistics over a table of runs: dataset = region, slice = nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.operators import stats, tables
from slicegauge.plans import hypotheses as hy
from .registry import Tables, query, rounded
from .sqlgen import draw, draw_int

# Divisors are primes, so that no mean of decimals sits on a rounding boundary.
# One region has a constant Q, one no R, one too few slices with a Q.
_Q = ("CASE WHEN r_name = 'AMERICA' THEN 0.5 WHEN n_name IN ('NATION_2', 'NATION_7') THEN NULL ELSE avg(c_acctbal) / 9973 END")
SLICE_SCORES = {"Q": _Q,
                "R": "CASE WHEN r_name <> 'EUROPE' THEN avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE 0 END) / 1999 END",
                "demographic_representation_gap": "avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) / 1999",
                "harm_content_density": "avg(CASE WHEN c_acctbal < 3000 THEN c_acctbal ELSE 0 END) / 2999",
                "S_composite": "avg(CASE WHEN c_acctbal > 6000 THEN c_acctbal ELSE 0 END) / 9973"}
MEASURES = {"accuracy": "avg(CAST(l_linestatus = 'O' AS INT))", "eod_worst": "avg(l_discount)", "dpd_worst": "avg(l_tax)",
            "worst_subgroup_error_gap": "avg(l_quantity) / 53", "mc1": "avg(CAST(l_discount > 0.05 AS INT))",
            "mc2": "avg(l_extendedprice) / 97003"}
_KEYS = "r_name AS dataset, n_name AS slice"
_WHERE = "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

SCORES_SQL = (f"scores AS (SELECT {_KEYS}, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in SLICE_SCORES.items())
              + f" FROM customer {_WHERE} GROUP BY r_name, n_name)")
UNIFORM_SQL = (f"uq AS (SELECT {_KEYS}, avg(o_totalprice) / 499979 AS q_uniform FROM orders JOIN customer ON o_custkey = c_custkey "
               f"{_WHERE} GROUP BY r_name, n_name)")
RUNS_SQL = (f"{SCORES_SQL}, meas AS (SELECT {_KEYS}, l_returnflag AS model_family, l_linenumber AS seed, count(*) AS n_test, "
            + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in MEASURES.items())
            + f" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {_WHERE} "
              "GROUP BY r_name, n_name, l_returnflag, l_linenumber), "
              "runs AS (SELECT m.*, " + ", ".join(f"s.{c}" for c in SLICE_SCORES)
            + " FROM meas m LEFT JOIN scores s USING (dataset, slice))")


def _placed(t: Tables) -> DataFrame:
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))


def slice_scores(t: Tables) -> DataFrame:
    return _placed(t).groupBy(F.col("r_name").alias("dataset"), F.col("n_name").alias("slice"), "r_name", "n_name").agg(
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in SLICE_SCORES.items()]).drop("r_name", "n_name")


def uniform_scores(t: Tables) -> DataFrame:
    return (t.orders.join(_placed(t), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("r_name").alias("dataset"), F.col("n_name").alias("slice"))
            .agg((F.avg("o_totalprice") / 499979).alias("q_uniform")))


def measures(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        _placed(t), F.col("o_custkey") == F.col("c_custkey"))
    return lines.groupBy(F.col("r_name").alias("dataset"), F.col("n_name").alias("slice"),
                         F.col("l_returnflag").alias("model_family"), F.col("l_linenumber").alias("seed")).agg(
        F.count(F.lit(1)).alias("n_test"), *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in MEASURES.items()])


def runs(t: Tables) -> DataFrame:
    return measures(t).join(slice_scores(t), ["dataset", "slice"], "left")


_ALL = [*MEASURES, *SLICE_SCORES]


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


@query("metrics_with_scores", f"WITH {RUNS_SQL} SELECT dataset, slice, model_family, seed, n_test, {_r(*_ALL, digits=10)} FROM runs")
def metrics_with_scores(t: Tables) -> DataFrame:
    return runs(t).selectExpr("dataset", "slice", "model_family", "seed", "n_test", *rounded(*_ALL, digits=10))


@query("slice_means", f"WITH {RUNS_SQL} SELECT dataset, slice, {_r(*_ALL)} FROM (SELECT dataset, slice, "
                      + ", ".join(f"avg({c}) AS {c}" for c in _ALL) + " FROM runs GROUP BY ALL)")
def slice_means(t: Tables) -> DataFrame:
    return stats.group_means(runs(t), ["dataset", "slice"], _ALL).selectExpr("dataset", "slice", *rounded(*_ALL, digits=6))


@query("conditional_vs_uniform_q", f"WITH {RUNS_SQL}, {UNIFORM_SQL} SELECT dataset, slice, {_r('Q', 'accuracy', 'q_uniform')} FROM ("
                                   "SELECT dataset, slice, avg(Q) AS Q, avg(accuracy) AS accuracy FROM runs GROUP BY ALL) LEFT JOIN uq USING (dataset, slice)")
def conditional_vs_uniform_q(t: Tables) -> DataFrame:
    agg = stats.group_means(runs(t), ["dataset", "slice"], ["Q", "accuracy"])
    return agg.join(uniform_scores(t), ["dataset", "slice"], "left").selectExpr(
        "dataset", "slice", *rounded("Q", "accuracy", "q_uniform", digits=6))


# --- correlation --------------------------------------------------------------

def _pearson_sql(x: str, y: str) -> str:
    vary = " AND ".join(f"max({c}) - min({c}) > 1e-12 * greatest(abs(max({c})), abs(min({c})))" for c in (x, y))
    return (f"CASE WHEN count({x}) >= 3 AND {vary} "
            f"THEN covar_pop({y}, {x}) / (stddev_pop({x}) * stddev_pop({y})) END")


_MAYBE = "SELECT l_returnflag, CASE WHEN l_tax > 0 THEN l_quantity END AS x, CASE WHEN l_linenumber < 7 THEN l_extendedprice END AS y FROM lineitem"


def _maybe(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_returnflag", "CASE WHEN l_tax > 0 THEN l_quantity END AS x",
                                 "CASE WHEN l_linenumber < 7 THEN l_extendedprice END AS y")


@query("safe_pearson", f"SELECT l_returnflag, count(*) AS n, round({_pearson_sql('x', 'y')}, 6) + 0.0 AS pearson_r "
                       f"FROM ({_MAYBE}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def safe_pearson(t: Tables) -> DataFrame:
    return stats.pearson(_maybe(t), "x", "y", ["l_returnflag"]).selectExpr("l_returnflag", "n", *rounded("pearson_r", digits=6))


@query("safe_pearson_runs", f"WITH {RUNS_SQL} SELECT dataset, model_family, count(*) AS n, round({_pearson_sql('Q', 'accuracy')}, 6) + 0.0 AS pearson_r "
                            "FROM runs WHERE Q IS NOT NULL AND accuracy IS NOT NULL GROUP BY 1, 2")
def safe_pearson_runs(t: Tables) -> DataFrame:
    return stats.pearson(runs(t), "Q", "accuracy", ["dataset", "model_family"]).selectExpr(
        "dataset", "model_family", "n", *rounded("pearson_r", digits=6))


def _ranks_sql(src: str, by: str) -> str:
    ar = "rank() OVER (PARTITION BY {b} ORDER BY {c}) + (count(*) OVER (PARTITION BY {b}, {c}) - 1) / 2.0 AS r{c}"
    return f"SELECT *, {ar.format(b=by, c='x')}, {ar.format(b=by, c='y')} FROM ({src}) WHERE x IS NOT NULL AND y IS NOT NULL"


@query("safe_spearman", f"SELECT l_returnflag, count(*) AS n, round({_pearson_sql('rx', 'ry')}, 6) + 0.0 AS spearman_rho "
                        f"FROM ({_ranks_sql(_MAYBE, 'l_returnflag')}) GROUP BY 1")
def safe_spearman(t: Tables) -> DataFrame:
    return stats.spearman(_maybe(t), "x", "y", ["l_returnflag"]).selectExpr("l_returnflag", "n", *rounded("spearman_rho", digits=6))


@query("delta_r2", f"""SELECT l_returnflag, count(*) AS n, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2_conditional,
  round(pow(corr(l_tax, l_extendedprice), 2), 6) AS r2_uniform,
  round(pow(corr(l_quantity, l_extendedprice), 2) - pow(corr(l_tax, l_extendedprice), 2), 6) + 0.0 AS delta_r2 FROM lineitem GROUP BY 1""")
def delta_r2(t: Tables) -> DataFrame:
    return stats.delta_r2(t.lineitem, "l_quantity", "l_tax", "l_extendedprice", ["l_returnflag"]).selectExpr(
        "l_returnflag", "n", *rounded("r2_conditional", "r2_uniform", "delta_r2", digits=6))


@query("trend_line", f"""WITH {RUNS_SQL}, a AS (SELECT dataset, slice, avg(Q) AS x, avg(accuracy) AS y FROM runs GROUP BY ALL)
  SELECT dataset, count(*) AS n, CASE WHEN max(x) - min(x) > 1e-12 * max(x) THEN round(regr_slope(y, x), 6) + 0.0 END AS slope,
  CASE WHEN max(x) - min(x) > 1e-12 * max(x) THEN round(regr_intercept(y, x), 6) + 0.0 END AS intercept FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def trend_line(t: Tables) -> DataFrame:
    agg = stats.group_means(runs(t), ["dataset", "slice"], ["Q", "accuracy"])
    return stats.trend_line(agg, "Q", "accuracy", ["dataset"]).selectExpr("dataset", "n", *rounded("slope", "intercept", digits=6))


@query("predictor_range", f"""WITH {SCORES_SQL} SELECT dataset, {_r('R_range', 'demographic_representation_gap_range')} FROM (
  SELECT dataset, max(R) - min(R) AS R_range, max(demographic_representation_gap) - min(demographic_representation_gap)
  AS demographic_representation_gap_range FROM scores GROUP BY 1) WHERE R_range >= 0.02 AND demographic_representation_gap_range >= 0.02""")
def predictor_range(t: Tables) -> DataFrame:
    out = stats.with_enough_range(slice_scores(t), {"R": 0.02, "demographic_representation_gap": 0.02}, ["dataset"])
    return out.selectExpr("dataset", *rounded("R_range", "demographic_representation_gap_range", digits=6))


# --- resampling ----------------------------------------------------------------

def pairs_sql(keys: str, pairs: list[tuple[str, str]], src: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, slice, '{x}' AS x_name, '{y}' AS y_name, {x} AS x, {y} AS y FROM {src} "
                              f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in pairs)


def tests_sql(keys: str, n_boot: int = 1000) -> str:
    """CTEs over `pr` (pairs): point estimates, ranks and bootstrap joined as `tests`."""
    g = f"{keys}, x_name, y_name"
    rank = "rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2.0 AS r{c}"
    d = draw_int(draw("'42'", "'draw'", "CAST(rep AS VARCHAR)", "CAST(pos AS VARCHAR)"))
    using = "USING (" + g + ")"
    return f"""point AS (SELECT {g}, count(*) AS n, {_pearson_sql('x', 'y')} AS pearson_r FROM pr GROUP BY ALL),
      rk AS (SELECT {g}, {_pearson_sql('rx', 'ry')} AS spearman_rho FROM (SELECT *, {rank.format(g=g, c='x')}, {rank.format(g=g, c='y')} FROM pr) GROUP BY ALL),
      ps AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {draw("'42'", "'position'", 'slice')}, slice) AS pos,
             count(*) OVER (PARTITION BY {g}) AS sz FROM pr),
      dr AS (SELECT {g}, rep, {d} % sz + 1 AS pos FROM (SELECT *, unnest(range(1, {n_boot + 1})) AS rep FROM ps WHERE sz >= 4)),
      bt AS (SELECT {g}, rep, {_pearson_sql('x', 'y')} AS r FROM dr JOIN ps USING ({g}, pos) GROUP BY ALL),
      ci AS (SELECT {g}, avg(r) AS r_mean, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high, count(r) AS n_resamples FROM bt GROUP BY ALL),
      tests AS (SELECT {g}, n AS n_slices, CASE WHEN n < 4 THEN 'underpowered' WHEN coalesce(n_resamples, 0) = 0 THEN 'all_resamples_invalid' ELSE 'ok' END AS status,
        round(pearson_r, 6) + 0.0 AS pearson_r, round(spearman_rho, 6) + 0.0 AS spearman_rho, round(r_mean, 6) + 0.0 AS r_mean,
        round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, coalesce(n_resamples, 0) AS n_resamples
        FROM point LEFT JOIN rk {using} LEFT JOIN ci {using})"""


_READ = """CASE WHEN status <> 'ok' THEN status || ' (n_slices=' || n_slices || ')' WHEN pearson_r IS NULL THEN 'no variance / undefined'
  ELSE CASE WHEN abs(pearson_r) < 0.3 THEN 'weak' WHEN abs(pearson_r) < 0.6 THEN 'moderate' ELSE 'strong' END || ' '
  || CASE WHEN pearson_r > 0 THEN 'positive' ELSE 'negative' END || printf(' (r=%.2f); ', pearson_r)
  || CASE WHEN ci_low > 0 OR ci_high < 0 THEN 'CI excludes zero' ELSE 'CI crosses zero (inconclusive)' END END AS interpretation"""
_STAT = ["pearson_r", "spearman_rho", "r_mean", "ci_low", "ci_high"]


def _tests(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.selectExpr(*keys, "x_name", "y_name", "status", "n_slices", "n_resamples", "interpretation",
                         *rounded(*_STAT, digits=6))


_AGG = "agg AS (SELECT dataset, slice, " + ", ".join(f"avg({c}) AS {c}" for c in _ALL) + " FROM runs GROUP BY ALL)"


@query("bootstrap_corr_ci", f"""WITH {RUNS_SQL}, {_AGG}, pr AS ({pairs_sql('dataset', [('eod_worst', 'accuracy')], 'agg')}), {tests_sql('dataset')}
  SELECT dataset, status, n_slices, r_mean, ci_low, ci_high, n_resamples FROM tests""")
def bootstrap_corr_ci(t: Tables) -> DataFrame:
    agg = stats.group_means(runs(t), ["dataset", "slice"], ["eod_worst", "accuracy"])
    pairs = stats.pairs_long(agg, ["dataset", "slice"], [("eod_worst", "accuracy")]).drop("x_name", "y_name")
    return stats.bootstrap(pairs, ["dataset"], "slice").selectExpr(
        "dataset", "status", "n_slices", "n_resamples", *rounded("r_mean", "ci_low", "ci_high", digits=6))


_ROWS = """(SELECT l_returnflag, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, CAST(l_quantity AS DOUBLE) AS x,
    CAST(l_quantity * (1 + l_tax * 10) + l_extendedprice / 5000 AS DOUBLE) AS y FROM lineitem)"""


@query("bootstrap_rows_ci", f"""WITH m AS (SELECT *, x - avg(x) OVER (PARTITION BY l_returnflag) AS cx, y - avg(y) OVER (PARTITION BY l_returnflag) AS cy FROM {_ROWS}),
  b AS (SELECT l_returnflag, {draw_int(draw("'42'", "'block'", "key"))} % 100 AS block, count(*) AS n, sum(cx) AS sx, sum(cy) AS sy, sum(cx * cx) AS sxx,
      sum(cy * cy) AS syy, sum(cx * cy) AS sxy FROM m GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY block) AS pos, count(*) OVER (PARTITION BY l_returnflag) AS size FROM b),
  d AS (SELECT l_returnflag, rep, {draw_int(draw("'42'", "'draw'", "CAST(rep AS VARCHAR)", "CAST(pos AS VARCHAR)"))} % size + 1 AS pos FROM p, range(1, 301) t(rep)),
  r AS (SELECT l_returnflag, rep, (sum(n) * sum(sxy) - sum(sx) * sum(sy)) / sqrt(sum(n) * sum(sxx) - sum(sx) * sum(sx)) / sqrt(sum(n) * sum(syy) - sum(sy) * sum(sy)) AS r
      FROM d JOIN p USING (l_returnflag, pos) GROUP BY ALL)
  SELECT l_returnflag, any_value(c.n_rows) AS n_rows, any_value(c.n_blocks) AS n_blocks, round(any_value(c.r), 6) AS pearson_r, round(avg(r.r), 6) AS r_mean,
      round(quantile_cont(r.r, 0.025), 6) AS ci_low, round(quantile_cont(r.r, 0.975), 6) AS ci_high, count(r.r) AS n_resamples
  FROM r JOIN (SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_blocks,
      sum(sxy) / sqrt(sum(sxx)) / sqrt(sum(syy)) AS r FROM b GROUP BY ALL) c USING (l_returnflag) GROUP BY l_returnflag""")
def bootstrap_rows_ci(t: Tables) -> DataFrame:
    """Confidence interval over all rows of lineitem from sums of hashed blocks."""
    pairs = t.lineitem.selectExpr("l_returnflag", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key", "CAST(l_quantity AS DOUBLE) AS x",
                                  "CAST(l_quantity * (1 + l_tax * 10) + l_extendedprice / 5000 AS DOUBLE) AS y")
    return stats.bootstrap_blocks(pairs, ["l_returnflag"], "key", 100, 300).selectExpr(
        "l_returnflag", "n_rows", "n_blocks", "n_resamples", *rounded("pearson_r", "r_mean", "ci_low", "ci_high", digits=6))


@query("h1_quality_accuracy", f"WITH {RUNS_SQL}, {_AGG}, pr AS ({pairs_sql('dataset', [('Q', 'accuracy')], 'agg')}), "
                              f"{tests_sql('dataset')} SELECT *, {_READ} FROM tests")
def h1_quality_accuracy(t: Tables) -> DataFrame:
    return _tests(hy.quality_accuracy(runs(t)), ["dataset"])


_H2 = [(x, y) for x in hy.RIGHTS_X for y in hy.RIGHTS_Y]


@query("h2_rights_fairness", f"""WITH {RUNS_SQL}, {_AGG}, pr AS ({pairs_sql('dataset', _H2, '(SELECT * FROM agg WHERE R IS NOT NULL)')}), {tests_sql('dataset')}
  SELECT *, {_READ} FROM tests UNION ALL BY NAME SELECT dataset, 'rights_axis_not_applicable' AS status FROM agg GROUP BY 1 HAVING count(R) = 0""")
def h2_rights_fairness(t: Tables) -> DataFrame:
    return _tests(hy.rights_fairness(runs(t)), ["dataset"])


_AGG3 = "agg AS (SELECT dataset, slice, model_family, " + ", ".join(f"avg({c}) AS {c}" for c in _ALL) + " FROM runs GROUP BY ALL)"
_H3 = [(x, y) for x in hy.SAFETY_X for y in hy.SAFETY_Y]


@query("h3_safety_factuality", f"WITH {RUNS_SQL}, {_AGG3}, pr AS ({pairs_sql('dataset, model_family', _H3, 'agg')}), "
                               f"{tests_sql('dataset, model_family')} SELECT *, {_READ} FROM tests")
def h3_safety_factuality(t: Tables) -> DataFrame:
    return _tests(hy.safety_factuality(runs(t)), ["dataset", "model_family"])


_PK = draw("'42'", "'perm'", "CAST(perm AS VARCHAR)", "slice")


@query("h4_permutation_delta_r2", f"""WITH {RUNS_SQL}, {UNIFORM_SQL}, b AS (SELECT * FROM (SELECT dataset, slice, avg(Q) AS Q, avg(accuracy) AS accuracy FROM runs GROUP BY ALL)
    LEFT JOIN uq USING (dataset, slice)), f AS (SELECT * FROM b WHERE Q IS NOT NULL AND q_uniform IS NOT NULL AND accuracy IS NOT NULL),
  pt AS (SELECT dataset, pow({_pearson_sql('Q', 'accuracy')}, 2) AS r2c, pow({_pearson_sql('q_uniform', 'accuracy')}, 2) AS r2u,
    max(Q) - min(Q) > 1e-12 * max(Q) AND max(q_uniform) - min(q_uniform) > 1e-12 * max(q_uniform) AS varies FROM f GROUP BY 1),
  ps AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {draw("'42'", "'position'", 'slice')}, slice) AS pos FROM f),
  sh AS (SELECT dataset, perm, accuracy AS ya, row_number() OVER (PARTITION BY dataset, perm ORDER BY {_PK}, slice) AS pos
    FROM (SELECT *, unnest(range(1, 1001)) AS perm FROM f)),
  dd AS (SELECT dataset, perm, pow({_pearson_sql('Q', 'ya')}, 2) - pow({_pearson_sql('q_uniform', 'ya')}, 2) AS d FROM sh JOIN ps USING (dataset, pos) GROUP BY 1, 2),
  pv AS (SELECT dataset, count(d) AS n_permutations, avg(CAST(abs(d) >= abs(r2c - r2u) - 1e-12 AS INT)) AS p FROM dd JOIN pt USING (dataset) WHERE d IS NOT NULL GROUP BY 1),
  st AS (SELECT dataset, count(*) FILTER (Q IS NOT NULL AND q_uniform IS NOT NULL AND accuracy IS NOT NULL) AS n_slices FROM b GROUP BY 1),
  o AS (SELECT st.*, CASE WHEN n_slices < 4 THEN 'underpowered' WHEN NOT varies THEN 'no_predictor_variance' ELSE 'ok' END AS status, r2c, r2u, p, n_permutations
    FROM st LEFT JOIN pt USING (dataset) LEFT JOIN pv USING (dataset))
  SELECT dataset, n_slices, status, CASE WHEN status = 'ok' THEN round(r2c, 6) END AS r2_conditional, CASE WHEN status = 'ok' THEN round(r2u, 6) END AS r2_uniform,
    CASE WHEN status = 'ok' THEN round(r2c - r2u, 6) + 0.0 END AS delta_r2, CASE WHEN status = 'ok' THEN round(p, 6) END AS permutation_p,
    CASE WHEN status = 'ok' THEN n_permutations END AS n_permutations,
    CASE WHEN status = 'ok' THEN CASE WHEN r2c - r2u > 0 THEN 'conditional > uniform' ELSE 'uniform > conditional' END || printf(' (ΔR²=%+.3f); ', r2c - r2u)
      || CASE WHEN p < 0.05 THEN 'statistically significant (p<.05)' ELSE 'not statistically significant' END END AS interpretation FROM o""")
def h4_permutation_delta_r2(t: Tables) -> DataFrame:
    return hy.conditional_weights(runs(t), uniform_scores(t)).selectExpr(
        "dataset", "n_slices", "status", "n_permutations", "interpretation",
        *rounded("r2_conditional", "r2_uniform", "delta_r2", "permutation_p", digits=6))


# --- run bookkeeping -------------------------------------------------------------

MODELS, SEEDS = ["logreg", "gbt", "mlp"], [42, 43, 44, 45, 46]
_GRID = ("grid AS (SELECT s.*, m.model_family, CAST(d.seed AS INT) AS seed FROM (SELECT DISTINCT r_name AS dataset, n_name AS slice FROM customer "
         f"{_WHERE}) s, (SELECT unnest({MODELS}) AS model_family) m, (SELECT unnest({SEEDS}) AS seed) d)")


def _grid(t: Tables) -> DataFrame:
    names = _placed(t).select(F.col("r_name").alias("dataset"), F.col("n_name").alias("slice")).distinct()
    return tables.run_grid(names, MODELS, SEEDS)


@query("run_grid", f"WITH {_GRID} SELECT * FROM grid")
def run_grid(t: Tables) -> DataFrame:
    return _grid(t)


_DONE = ("SELECT DISTINCT n_name AS slice, CASE l_returnflag WHEN 'A' THEN 'logreg' WHEN 'N' THEN 'gbt' END AS model_family, 41 + l_linenumber AS seed "
         f"FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {_WHERE} WHERE l_quantity > 40 AND l_discount > 0.08")


@query("pending_runs", f"WITH {_GRID} SELECT g.* FROM grid g ANTI JOIN ({_DONE}) d ON g.slice = d.slice AND g.model_family = d.model_family AND g.seed = d.seed")
def pending_runs(t: Tables) -> DataFrame:
    done = (t.lineitem.where("l_quantity > 40 AND l_discount > 0.08").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(_placed(t), F.col("o_custkey") == F.col("c_custkey"))
            .selectExpr("n_name AS slice", "CASE l_returnflag WHEN 'A' THEN 'logreg' WHEN 'N' THEN 'gbt' END AS model_family",
                        "41 + l_linenumber AS seed").distinct())
    return tables.pending_runs(_grid(t), done)
