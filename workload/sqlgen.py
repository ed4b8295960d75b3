"""Oracle SQL fragments (DuckDB dialect) for the scans several queries share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def select_by(by: Sequence[str]) -> str:
    return "".join(f"{b}, " for b in by)


def tv_sql(table: str, reference: Mapping[str, Mapping[str, float]], by: str) -> str:
    """SELECT by, tv (mean over the reference's columns): full outer join on the category."""
    counts = " UNION ALL ".join(
        f"SELECT {by} AS g, '{c}' AS col, CAST({c} AS VARCHAR) AS v, count(*) AS c FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in reference)
    ref = ", ".join(f"('{c}', '{v}', CAST({p} AS DOUBLE))" for c, ps in reference.items() for v, p in ps.items())
    return f"""
    SELECT g AS {by}, avg(tv) AS tv FROM (
      SELECT coalesce(e.g, r.g) AS g, coalesce(e.col, r.col) AS col,
             0.5 * sum(abs(coalesce(e.p, 0) - coalesce(r.p, 0))) AS tv
      FROM (SELECT g, col, v, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY g, col) AS p FROM ({counts})) e
      FULL OUTER JOIN (SELECT d.g, x.* FROM (SELECT DISTINCT {by} AS g FROM {table}) d,
                       (VALUES {ref}) x(col, v, p)) r
        ON e.g = r.g AND e.col = r.col AND e.v = r.v
      GROUP BY ALL) GROUP BY g"""


def outlier_sql(table: str, columns: Sequence[str], by: str) -> str:
    """SELECT by, col, n, lo, hi, n_out, share for the usable numeric columns."""
    return " UNION ALL ".join(f"""
    SELECT t.{by}, '{c}' AS col, any_value(b.n) AS n, any_value(b.lo) AS lo, any_value(b.hi) AS hi,
           count(*) FILTER ({c} < b.lo OR {c} > b.hi) AS n_out,
           count(*) FILTER ({c} < b.lo OR {c} > b.hi) / CAST(any_value(b.n) AS DOUBLE) AS share
    FROM {table} t JOIN (
      SELECT {by}, n, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (
        SELECT {by}, count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
               quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
        FROM {table} GROUP BY {by}) WHERE n >= 4 AND q3 <> q1) b ON t.{by} = b.{by}
    GROUP BY t.{by}""" for c in columns)


def error_sql(table: str, columns: Sequence[str], numeric: Sequence[str], by: str) -> str:
    """SELECT by, missing, dup, outl, score of the error proxy."""
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    out = (f"SELECT {by}, avg(share) AS o FROM ({outlier_sql(table, numeric, by)}) GROUP BY {by}"
           if numeric else f"SELECT {by}, 0.0 AS o FROM {table} WHERE false")
    return f"""
    SELECT m.{by}, m.missing, d.dup, coalesce(x.o, 0) AS outl,
           1 - (0.5 * m.missing + 0.3 * d.dup + 0.2 * coalesce(x.o, 0)) AS score
    FROM (SELECT {by}, ({nulls}) / (count(*) * CAST({len(columns)} AS DOUBLE)) AS missing
          FROM {table} GROUP BY {by}) m
    JOIN (SELECT {by}, sum(c - 1) / CAST(sum(c) AS DOUBLE) AS dup FROM (
            SELECT {by}, {', '.join(columns)}, count(*) AS c FROM {table} GROUP BY ALL) GROUP BY {by}) d
      ON m.{by} = d.{by}
    LEFT JOIN ({out}) x ON m.{by} = x.{by}"""


def kanon_sql(table: str, columns: Sequence[str], by: str) -> str:
    cols = ", ".join(columns)
    return f"""
    SELECT {by}, min(c) AS k, count(*) AS n_classes, 1 / (1 + min(c) / 5.0) AS risk
    FROM (SELECT {by}, {cols}, count(*) AS c FROM {table} GROUP BY ALL) GROUP BY {by}"""


def nmi_sql(table: str, numeric: Sequence[str], text: Sequence[str], protected: Sequence[str], by: str) -> str:
    """SELECT by, feature, protected, n, nmi; numeric columns fall into deciles of their group."""
    edges = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS e_{c}"
                      for c in numeric)
    labels = [f"CASE WHEN {c} IS NOT NULL THEN CAST(len(list_filter(e_{c}[2:10], "
              f"lambda v: CAST({c} AS DOUBLE) > v AND v > e_{c}[1])) AS VARCHAR) END AS {c}" for c in numeric]
    labels += [f"CAST({c} AS VARCHAR) AS {c}" for c in text]
    num = f"JOIN (SELECT {by} AS g, {edges} FROM {table} GROUP BY {by}) e ON t.{by} = e.g" if numeric else ""
    feats = [c for c in [*numeric, *text] if c not in protected]
    pairs = " UNION ALL ".join(
        f"SELECT {by} AS g, '{f}' AS f, '{p}' AS pa, {f} AS x, {p} AS y, count(*) AS c FROM lab "
        f"WHERE {f} IS NOT NULL AND {p} IS NOT NULL GROUP BY ALL" for f in feats for p in protected)
    return f"""
    WITH lab AS MATERIALIZED (SELECT t.{by}, {', '.join(labels)} FROM {table} t {num}),
    joint AS (SELECT *, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY g, f, pa) AS p,
                     sum(c) OVER (PARTITION BY g, f, pa) AS n FROM ({pairs})),
    m AS (SELECT *, sum(p) OVER (PARTITION BY g, f, pa, x) AS px, sum(p) OVER (PARTITION BY g, f, pa, y) AS py,
                 row_number() OVER (PARTITION BY g, f, pa, x) AS ix, row_number() OVER (PARTITION BY g, f, pa, y) AS iy
          FROM joint)
    SELECT g AS {by}, f AS feature, pa AS protected, CAST(max(n) AS BIGINT) AS n,
           CASE WHEN max(px) > 1 - 1e-12 OR max(py) > 1 - 1e-12 THEN 0.0
                ELSE 2 * sum(p * ln(p / (px * py)))
                     / (sum(CASE WHEN ix = 1 THEN -px * ln(px) ELSE 0 END)
                        + sum(CASE WHEN iy = 1 THEN -py * ln(py) ELSE 0 END)) END AS nmi
    FROM m GROUP BY g, f, pa"""


def draw(*parts: str) -> str:
    """md5 hex of the parts joined by colons."""
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


def draw_int(key: str) -> str:
    return f"CAST(('0x' || substr({key}, 1, 15)) AS BIGINT)"
