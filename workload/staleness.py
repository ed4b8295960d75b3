"""Stored scores against the table as it has become since."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicegauge.operators import staleness
from .registry import AS_OF, Tables, query, rounded

_CUT = "1999-01-01"
_CELLS = {"l_linestatus": "l_linestatus", "l_discount": "CAST(l_discount AS VARCHAR)", "ship_year": "CAST(year(l_shipdate) AS VARCHAR)"}
_LONG = " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS c, {e} AS v, CAST(l_shipdate < TIMESTAMP '{_CUT}' AS INT) AS old FROM lineitem"
                           for c, e in _CELLS.items())


@query("stale_scores", f"""WITH k AS (SELECT l_returnflag, c, v, coalesce(sum(old), 0) AS a, count(*) AS b FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY ALL),
  t AS (SELECT l_returnflag, c, sum(a) AS n_then, sum(b) AS n_now FROM k GROUP BY ALL),
  d AS (SELECT k.l_returnflag, k.c, n_then, n_now, sum(abs(a / n_then - b / n_now)) / 2 AS drift
    FROM k JOIN t ON k.c = t.c AND k.l_returnflag IS NOT DISTINCT FROM t.l_returnflag GROUP BY ALL),
  f AS (SELECT l_returnflag, exp(-greatest(0, epoch_us(TIMESTAMP '{_CUT}') - epoch_us(max(l_shipdate))) / 86400e6 / 3650.0) AS before_,
    exp(-greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(l_shipdate))) / 86400e6 / 3650.0) AS now_
    FROM lineitem WHERE l_shipdate < TIMESTAMP '{_CUT}' GROUP BY l_returnflag)
SELECT d.l_returnflag, c AS "column", CAST(n_then AS BIGINT) AS n_then, CAST(n_now AS BIGINT) AS n_now, round(drift, 8) AS drift,
  round(before_, 8) AS timeliness_then, round(now_, 8) AS timeliness_now,
  nullif(concat_ws(',', CASE WHEN drift > 0.1 THEN 'drift' END, CASE WHEN before_ - now_ > 0.95 THEN 'age' END), '') AS reason,
  drift > 0.1 OR before_ - now_ > 0.95 AS stale
FROM d LEFT JOIN f ON d.l_returnflag IS NOT DISTINCT FROM f.l_returnflag""")
def stale_scores(t: Tables) -> DataFrame:
    now = t.lineitem.withColumn("ship_year", F.year("l_shipdate"))
    old = now.where(F.col("l_shipdate") < F.lit(_CUT).cast("timestamp"))
    dated = old.groupBy("l_returnflag").agg(F.max("l_shipdate").cast("timestamp").alias("updated"),
                                            F.lit(_CUT).cast("timestamp").alias("scored_at"))
    by, columns = ["l_returnflag"], list(_CELLS)
    out = staleness.stale_scores(staleness.share_snapshot(old, columns, by), staleness.share_snapshot(now, columns, by), dated,
                                 AS_OF, by, max_drift=0.1, max_fade=0.95, half_life_days=3650.0)
    return out.selectExpr("l_returnflag", "column", "n_then", "n_now", *rounded("drift", "timeliness_then", "timeliness_now"), "reason", "stale")
