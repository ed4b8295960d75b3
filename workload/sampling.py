"""Slicing strategies and hash-ordered draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.functions import scalars, text
from slicegauge.operators import sampling as sm
from .features import COHORT_SQL, COHORTS, OWN_URLS, url_sql
from .registry import Tables, query
from .sqlgen import draw, draw_int


@query("hash_sample", f"""SELECT doc_id, lang FROM documents QUALIFY
  row_number() OVER (PARTITION BY lang ORDER BY {draw("'42'", "'sample'", "CAST(doc_id AS VARCHAR)")}, doc_id) <= 50""")
def hash_sample(t: Tables) -> DataFrame:
    return sm.hash_sample(t.documents.select("doc_id", "lang"), 50, "doc_id", by=["lang"])


@query("slice_by_key", f"""SELECT 'nation_' || n_name || '_2018' AS slice, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_24', 'NATION_99') QUALIFY
  row_number() OVER (PARTITION BY n_name ORDER BY {draw("'7'", "'cap'", "CAST(c_custkey AS VARCHAR)")}, c_custkey) <= 40""")
def slice_by_key(t: Tables) -> DataFrame:
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    wanted = ["NATION_1", "NATION_2", "NATION_3", "NATION_24", "NATION_99"]
    return sm.slice_by_key(people, "n_name", "c_custkey", wanted, 40, 7, "nation_", "_2018").select("slice", "c_custkey")


@query("slice_by_cohort", f"""WITH p AS (SELECT p_partkey, {COHORT_SQL} AS cohort FROM part),
  n AS (SELECT *, count(*) OVER (PARTITION BY cohort) AS n,
    row_number() OVER (PARTITION BY cohort ORDER BY {draw("'42'", "'cap'", "CAST(p_partkey AS VARCHAR)")}, p_partkey) AS r FROM p)
  SELECT 'size_' || cohort || '_n' || least(n, 300) AS slice, p_partkey FROM n WHERE n >= 100 AND r <= 300""")
def slice_by_cohort(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", scalars.code_label(F.col("p_size"), COHORTS).alias("cohort"))
    return sm.slice_by_cohort(p, "cohort", "p_partkey", None, 100, 300, prefix="size_").select("slice", "p_partkey")


YEARS = [[1992, 1994], [1994, 1995, 1996], [1998], [2001, 2003]]


@query("slice_by_year_group", " UNION ALL ".join(
    f"SELECT 'orders_{g[0]}_{g[-1]}_slice_{i:02d}' AS slice, count(*) AS n, round(sum(o_totalprice), 1) AS total "
    f"FROM orders WHERE year(o_orderdate) BETWEEN {g[0]} AND {g[-1]} HAVING count(*) > 0" for i, g in enumerate(YEARS)))
def slice_by_year_group(t: Tables) -> DataFrame:
    o = t.orders.select(F.year("o_orderdate").alias("y"), "o_totalprice")
    return sm.slice_by_ranges(o, "y", YEARS, "orders_").groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def _pool_sql(label: str, table: str, key: str) -> str:
    return (f"pool AS (SELECT {key} AS key, {label} AS lab, row_number() OVER (PARTITION BY {label} ORDER BY "
            f"{draw(repr('42'), repr('position'), f'CAST({key} AS VARCHAR)')}, {key}) AS pos, "
            f"count(*) OVER (PARTITION BY {label}) AS n FROM {table})")


_SIZES = [200, 350, 500]
_N = "(SELECT count(*) FILTER (quality = 1) AS p, count(*) AS n FROM labels)"
_PLAN = " UNION ALL ".join(
    f"SELECT 'quality_slice_{i:02d}_n{s}' AS slice, 1 AS lab, CAST(round_even({s} * (p / CAST(n AS DOUBLE)), 0) AS BIGINT) AS k, {s} AS tot FROM {_N}"
    for i, s in enumerate(_SIZES))


def _draw_sql(plan: str) -> str:
    """Draws with replacement from `pool` for a plan (slice, lab, k)."""
    h = draw("'42'", "'draw'", "slice", "CAST(lab AS VARCHAR)", "CAST(d AS VARCHAR)")
    return (f"SELECT d.slice, d.d AS draw, p.key, p.lab FROM (SELECT x.slice, x.lab, unnest(range(1, x.k + 1)) AS d FROM ({plan}) x) d "
            f"JOIN (SELECT DISTINCT lab, n FROM pool) z ON d.lab = z.lab "
            f"JOIN pool p ON p.lab = d.lab AND p.pos = {draw_int(h.replace('slice', 'd.slice').replace('(lab', '(d.lab').replace('(d AS', '(d.d AS'))} % z.n + 1")


@query("stratified_bootstrap", f"""WITH {_pool_sql('quality', 'labels', 'doc_id')}, pl AS ({_PLAN}),
  plan AS (SELECT slice, lab, k FROM pl UNION ALL SELECT slice, 0, tot - k FROM pl)
  SELECT slice, draw, key AS doc_id, CAST(lab AS INT) AS quality FROM ({_draw_sql('SELECT * FROM plan')})""")
def stratified_bootstrap(t: Tables) -> DataFrame:
    out = sm.stratified_bootstrap(t.labels, "quality", "doc_id", _SIZES, prefix="quality_")
    return out.select("slice", "draw", "doc_id", "quality")


_SHARES, _ROWS = [0.02, 0.05, 0.1, 0.35], 250


def _share_slices(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "toxic")
    return sm.slice_by_label_share(rows, "toxic", "doc_id", _SHARES, _ROWS, prefix="docs_")


_SHARE_NAMES = [(f"docs_p{int(p * 100):03d}_slice_{i:02d}", round(_ROWS * p)) for i, p in enumerate(_SHARES)]
_SHARE_PLAN = " UNION ALL ".join(f"SELECT '{s}' AS slice, {v} AS lab, {k} AS k" for s, n1 in _SHARE_NAMES
                                 for v, k in ((1, n1), (0, _ROWS - n1)))
_SHARE_KEY = draw("'42'", "'share'", "slice", "CAST(key AS VARCHAR)")
_SHARE_CTE = f"""{_pool_sql('toxic', '(SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id))', 'doc_id')},
  plan AS ({_SHARE_PLAN}), sizes AS (SELECT DISTINCT lab, n FROM pool),
  once AS (SELECT slice, CAST(1 AS BIGINT) AS draw, key, lab FROM (
    SELECT p.slice, q.key, q.lab, p.k, row_number() OVER (PARTITION BY p.slice, q.lab ORDER BY {_SHARE_KEY.replace('slice', 'p.slice').replace('CAST(key', 'CAST(q.key')}, q.key) AS r
    FROM plan p JOIN pool q ON p.lab = q.lab WHERE p.k <= q.n) WHERE r <= k),
  again AS ({_draw_sql('SELECT p.slice, p.lab, p.k FROM plan p JOIN sizes s ON p.lab = s.lab WHERE p.k > s.n')}),
  sl AS (SELECT * FROM once UNION ALL SELECT * FROM again)"""


@query("slice_by_label_share", f"WITH {_SHARE_CTE} SELECT slice, draw, key AS doc_id, CAST(lab AS INT) AS toxic FROM sl")
def slice_by_label_share(t: Tables) -> DataFrame:
    return _share_slices(t).select("slice", "draw", "doc_id", "toxic")


@query("slice_manifest", f"""WITH {_SHARE_CTE} SELECT slice, count(*) AS n_rows, CAST(sum(lab) AS BIGINT) AS n_toxic,
  slice || '.parquet' AS filename FROM sl GROUP BY slice""")
def slice_manifest(t: Tables) -> DataFrame:
    return sm.slice_manifest(_share_slices(t), "toxic")


_CATS = ["www", "blog", "mobile"]


def _quota_sql(seen: str) -> str:
    return f"""WITH c AS (SELECT page_id, {url_sql(OWN_URLS)} AS category FROM {seen}),
  q AS (SELECT category, page_id FROM c WHERE category IN ('www', 'blog', 'mobile')
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY page_id) <= 50)"""


_FIRST = "(SELECT page_id, url FROM pages ORDER BY page_id LIMIT 101)"


def _quota(t: Tables, cap: int | None = None) -> DataFrame:
    return sm.quota_per_category(t.pages.select("page_id", "url"), text.url_category(F.col("url"), OWN_URLS), "page_id", _CATS, 50, cap)


@query("quota_per_category", f"{_quota_sql('pages')} SELECT * FROM q")
def quota_per_category(t: Tables) -> DataFrame:
    return _quota(t).select("category", "page_id")


@query("quota_per_category_capped", f"{_quota_sql(_FIRST)} SELECT * FROM q")
def quota_per_category_capped(t: Tables) -> DataFrame:
    """A cap that bites: 100 pages read for three times 50 wanted."""
    return _quota(t, 100).select("category", "page_id")


@query("quota_shortfall", f"""{_quota_sql(_FIRST)} SELECT w.category, count(q.page_id) AS n_rows, 50 - count(q.page_id) AS shortfall
  FROM (VALUES ('www'), ('blog'), ('mobile')) w(category) LEFT JOIN q ON q.category = w.category GROUP BY w.category""")
def quota_shortfall(t: Tables) -> DataFrame:
    return sm.quota_shortfall(_quota(t, 100), _CATS, 50)


@query("stratified_split", f"""SELECT doc_id, quality, r <= round_even(n * 0.2, 0) AS is_test FROM (
  SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n,
    row_number() OVER (PARTITION BY quality ORDER BY {draw("'43'", "'split'", "CAST(doc_id AS VARCHAR)")}, doc_id) AS r FROM labels)""")
def stratified_split(t: Tables) -> DataFrame:
    return sm.stratified_split(t.labels, "quality", "doc_id", 43).select("doc_id", "quality", "is_test")
