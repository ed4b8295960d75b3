"""Row-wise derivations, joins and pivots of the preparation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.functions import dates, scalars, text
from slicegauge.operators import factuality, stats, tables
from .registry import Tables, query, rounded


@query("binarize_target", """SELECT o_orderpriority, CAST(sum(CAST(o_totalprice >= 250000 AS INT)) AS BIGINT) AS n_high,
  CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS n_final,
  CAST(sum(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS n_early,
  CAST(sum(CASE WHEN o_totalprice >= 100000 AND o_totalprice >= 250000 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_known
  FROM orders GROUP BY o_orderpriority""")
def binarize_target(t: Tables) -> DataFrame:
    known = F.expr("CASE WHEN o_totalprice >= 100000 THEN o_totalprice END")
    return t.orders.groupBy("o_orderpriority").agg(
        F.sum(scalars.at_least(F.col("o_totalprice"), 250000)).alias("n_high"),
        F.sum(scalars.equals(F.col("o_orderstatus"), "F")).alias("n_final"),
        F.sum(scalars.flag(F.expr("o_orderdate < timestamp'1996-01-01 00:00:00'"))).alias("n_early"),
        F.sum(scalars.at_least(known, 250000)).alias("n_high_known"))


COHORTS = {"tiny": [1, 2, 3, 13], "small": [4, 5, 6, 7, 8], "odd": [13, 14], "large": [40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50]}
COHORT_SQL = ("CASE WHEN p_size IN (1, 2, 3) THEN 'tiny' WHEN p_size IN (4, 5, 6, 7, 8) THEN 'small' WHEN p_size IN (13, 14) "
              "THEN 'odd' WHEN p_size BETWEEN 40 AND 50 THEN 'large' ELSE 'other' END")


@query("code_to_cohort", f"SELECT p_partkey, {COHORT_SQL} AS cohort FROM part")
def code_to_cohort(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalars.code_label(F.col("p_size"), COHORTS).alias("cohort"))


@query("interval_bins", """SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN NULL WHEN c_acctbal <= 2500 THEN 'low'
  WHEN c_acctbal <= 5000 THEN 'mid' WHEN c_acctbal <= 9000 THEN 'high' END AS band FROM customer""")
def interval_bins(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", scalars.interval_label(
        F.col("c_acctbal"), [0, 2500, 5000, 9000], ["low", "mid", "high"]).alias("band"))


KEYWORDS = {"METAL": ["STEEL", "COPPER"], "BUDGET": ["ECONOMY"], "NORMAL": ["STANDARD", "MEDIUM"]}


@query("keyword_category", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'UNKNOWN'
  WHEN contains(upper(p_type), 'STEEL') OR contains(upper(p_type), 'COPPER') THEN 'METAL'
  WHEN contains(upper(p_type), 'ECONOMY') THEN 'BUDGET'
  WHEN contains(upper(p_type), 'STANDARD') OR contains(upper(p_type), 'MEDIUM') THEN 'NORMAL' ELSE 'OTHER' END AS kind FROM part""")
def keyword_category(t: Tables) -> DataFrame:
    kind = text.keyword_category(F.expr("lower(nullif(p_type, 'PROMO'))"), KEYWORDS)
    return t.part.select("p_partkey", kind.alias("kind"))


OWN_URLS = {"blog": [r"//blog\."], "mobile": [r"//m\."], "www": [r"//www\."], "tracked": [r"[?&]ref="]}


def url_sql(categories: dict, column: str = "url") -> str:
    arms = " ".join("WHEN " + " OR ".join(f"regexp_matches(lower({column}), '{p}')" for p in ps) + f" THEN '{c}'"
                    for c, ps in categories.items())
    return f"CASE {arms} ELSE 'other' END"


@query("url_category", f"SELECT page_id, {url_sql(OWN_URLS)} AS category FROM pages")
def url_category(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.url_category(F.col("url"), OWN_URLS).alias("category"))


@query("url_category_stock", f"SELECT {url_sql(text.URL_CATEGORIES)} AS category, count(*) AS n FROM pages GROUP BY 1")
def url_category_stock(t: Tables) -> DataFrame:
    return t.pages.groupBy(text.url_category(F.col("url")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("time_features", """SELECT event_id, round((epoch_us(ts) - epoch_us(f.first_ts)) / 3.6e9, 6) + 0.0 AS hours_since_first,
  CAST(year(ts) AS INT) AS y FROM events e JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) f USING (user_id)""")
def time_features(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    e = t.events.join(first, "user_id").withColumn("h", dates.hours_between(F.col("first_ts"), F.col("ts")))
    return e.selectExpr("event_id", "round(h, 6) + 0.0D AS hours_since_first", "year(ts) AS y")


@query("parsed_dates", """SELECT o_orderkey, CAST(epoch_us(o_orderdate) / 1000000 AS BIGINT) AS from_date,
  CAST(epoch_us(o_orderdate) / 1000000 AS BIGINT) + 3600 * 11 AS from_zoned,
  CAST(epoch_us(o_orderdate) / 1000000 AS BIGINT) AS from_basic FROM orders""")
def parsed_dates(t: Tables) -> DataFrame:
    o = t.orders.selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS a",
                            "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T09:00:00.000-02:00') AS b",
                            "date_format(o_orderdate, 'yyyyMMdd') AS c")
    secs = "CAST(unix_micros({}) / 1000000 AS BIGINT)"
    return o.selectExpr("o_orderkey", *[f"{secs.format(dates.parse_iso(c))} AS {n}" for c, n in (
        ("a", "from_date"), ("b", "from_zoned"), ("c", "from_basic"))])


@query("interpret_correlation", """WITH r AS (SELECT l_linenumber, l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_linenumber, l_returnflag, CASE WHEN n < 900 THEN 'underpowered (n_slices=' || n || ')'
   ELSE CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' ELSE 'strong' END || ' '
     || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || printf(' (r=%.2f); ', r)
     || CASE WHEN r - 0.3 > 0 OR r + 0.3 < 0 THEN 'CI excludes zero' ELSE 'CI crosses zero (inconclusive)' END END AS reading,
   CASE WHEN r > 0 THEN 'conditional > uniform' ELSE 'uniform > conditional' END || printf(' (ΔR²=%+.3f); ', r)
     || CASE WHEN abs(r) < 0.05 THEN 'statistically significant (p<.05)' ELSE 'not statistically significant' END AS delta_reading
  FROM r""")
def interpret_correlation(t: Tables) -> DataFrame:
    r = stats.pearson(t.lineitem, "l_quantity", "l_extendedprice", ["l_linenumber", "l_returnflag"])
    c = F.col("pearson_r")
    status = F.when(F.col("n") < 900, "underpowered").otherwise("ok")
    return r.select("l_linenumber", "l_returnflag",
                    scalars.interpret_correlation(c, status, F.col("n"), c - 0.3, c + 0.3).alias("reading"),
                    scalars.interpret_delta_r2(c, F.abs(c)).alias("delta_reading"))


@query("flat_feature_table", """SELECT o.o_orderkey, c.c_mktsegment, CAST(coalesce(n.n_lines, 0) AS INT) AS n_lines,
  CAST(year(o_orderdate) AS INT) AS order_year, CAST(40 + year(o_orderdate) - 1995 AS INT) AS age
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) n ON o.o_orderkey = n.l_orderkey""")
def flat_feature_table(t: Tables) -> DataFrame:
    flat = tables.flat_table(t.orders, t.customer, ("o_custkey", "c_custkey"), t.lineitem, ("o_orderkey", "l_orderkey"), "n_lines")
    flat = flat.withColumns({"order_year": F.year("o_orderdate"), "anchor_age": F.lit(40), "anchor_year": F.lit(1995)})
    flat = scalars.with_age(flat, "anchor_age", "order_year", "anchor_year")
    return flat.select("o_orderkey", "c_mktsegment", scalars.filled_int(F.col("n_lines")).alias("n_lines"), "order_year", "age")


@query("runs_pivot", """SELECT CAST(user_id % 10 AS INT) AS bucket, """ + ", ".join(
    f"count(*) FILTER (event_type = '{e}') AS n_{e}, round(avg(value) FILTER (event_type = '{e}'), 6) AS mean_{e}"
    for e in ("click", "error", "purchase", "refund", "signup", "view")) + " FROM events GROUP BY 1")
def runs_pivot(t: Tables) -> DataFrame:
    kinds = ["click", "error", "purchase", "refund", "signup", "view"]
    e = t.events.selectExpr("CAST(user_id % 10 AS INT) AS bucket", "event_type", "value")
    both = tables.counts_pivot(e, ["bucket"], "event_type", kinds).join(
        tables.means_pivot(e, ["bucket"], "event_type", kinds, "value"), "bucket")
    return both.selectExpr("bucket", *[f"n_{k}" for k in kinds], *[f"round(mean_{k}, 6) AS mean_{k}" for k in kinds])


@query("run_status", """SELECT event_type, CASE WHEN value >= 5 THEN 'ok' WHEN value >= 2 THEN 'failed' END AS status, count(*) AS n
  FROM events GROUP BY ALL""")
def run_status(t: Tables) -> DataFrame:
    e = t.events.selectExpr("event_type", "CASE WHEN value >= 5 THEN 'ok' WHEN value >= 2 THEN 'failed' END AS status")
    return tables.status_counts(e, ["event_type"])


@query("tagged_union", """SELECT color, count(*) AS n, count(c_mktsegment) AS n_segment, round(sum(balance), 2) AS balance FROM (
  SELECT 'red' AS color, c_acctbal AS balance, c_mktsegment FROM customer UNION ALL
  SELECT 'white', s_acctbal, NULL FROM supplier) GROUP BY color""")
def tagged_union(t: Tables) -> DataFrame:
    frames = {"red": t.customer.selectExpr("c_acctbal AS balance", "c_mktsegment"),
              "white": t.supplier.selectExpr("s_acctbal AS balance")}
    return tables.tagged_union(frames, "color").groupBy("color").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_mktsegment").alias("n_segment"), F.round(F.sum("balance"), 2).alias("balance"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


@query("table_fingerprint", f"""SELECT lang, count(*) AS n_rows, CAST(sum(CAST(CAST(('0x' || substr(md5(
  {' || '.join(map(_field, ['CAST(doc_id AS VARCHAR)', 'text', 'source', 'CAST(n_chars AS VARCHAR)']))}), 1, 16)) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS content_hash
  FROM documents GROUP BY lang""")
def table_fingerprint(t: Tables) -> DataFrame:
    return tables.fingerprint(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), ["lang"])


# --- factuality: user = question, event = choice, ll = -value, label = purchase --

_CHOICES = ("(SELECT CAST(user_id AS BIGINT) AS q, event_id AS idx, CAST(floor(value / 5) AS DOUBLE) * -1 AS ll, "
            "CAST(event_type = 'purchase' AS INT) AS label, CAST(month(ts) AS INT) AS m FROM events)")


def choices(t: Tables) -> DataFrame:
    return t.events.selectExpr("user_id AS q", "event_id AS idx", "CAST(floor(value / 5) AS DOUBLE) * -1 AS ll",
                               "CAST(event_type = 'purchase' AS INT) AS label", "month(ts) AS m")


@query("mc1_score", f"""SELECT m, round(avg(CAST(top = right_ AS INT)), 8) AS mc1, count(*) AS n_questions FROM (
  SELECT m, q, first(idx ORDER BY ll DESC, idx) AS top, first(idx ORDER BY label DESC, idx) AS right_ FROM {_CHOICES} GROUP BY m, q) GROUP BY m""")
def mc1_score(t: Tables) -> DataFrame:
    return factuality.mc1(choices(t), "q", ["m"]).selectExpr("m", *rounded("mc1"), "n_questions")


@query("mc2_score", f"""SELECT m, round(avg(p), 8) + 0.0 AS mc2, count(*) AS n_questions FROM (
  SELECT m, q, sum(exp(ll - mx) * label) / sum(exp(ll - mx)) AS p FROM (SELECT *, max(ll) OVER (PARTITION BY m, q) AS mx FROM {_CHOICES}) GROUP BY m, q) GROUP BY m""")
def mc2_score(t: Tables) -> DataFrame:
    return factuality.mc2(choices(t), "q", ["m"]).selectExpr("m", *rounded("mc2"), "n_questions")
