"""Stored share snapshots against later tables, by plain counting; edges of groups and dates."""

from collections import Counter

from slicegauge.operators.staleness import share_drift, share_snapshot, stale_scores

SCHEMA = "g string, x int, s string"
THEN = [("a", 1, "u"), ("a", 1, "v" * 5000), ("a", 2, None), (None, 3, "u"), ("gone", 1, "u")]
NOW = [("a", 1, "u"), ("a", 2, "v" * 5000), ("a", 2, "w"), (None, 3, "u"), (None, 3, "u"), ("new", 1, None), ("new", 7, "u")]


def slow(then, now, group, at):
    p, q = [Counter(r[at] for r in rows if r[0] == group and r[at] is not None) for rows in (then, now)]
    if not p or not q:
        return 1.0
    return sum(abs(p[v] / p.total() - q[v] / q.total()) for v in p | q) / 2


def test_drift(spark):
    then = share_snapshot(spark.createDataFrame(THEN, SCHEMA), ["x", "s"], ["g"])
    # a column whose type was widened keeps its values
    now = share_snapshot(spark.createDataFrame(NOW, SCHEMA).selectExpr("g", "CAST(x AS DOUBLE) AS x", "s"), ["x", "s"], ["g"])
    rows = share_drift(then, now, ["g"]).collect()
    assert {(r.g, r.column) for r in rows} == {(g, c) for g in ("a", None, "gone", "new") for c in ("x", "s")}
    for r in rows:
        assert abs(r.drift - slow(THEN, NOW, r.g, 1 if r.column == "x" else 2)) < 1e-12
    assert max(r.value is not None and len(r.value) for r in then.collect()) < 100


def test_reasons(spark):
    then, now = [share_snapshot(spark.createDataFrame(r, SCHEMA), ["x"], ["g"]) for r in (THEN, NOW)]
    dated = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-02'), (NULL, TIMESTAMP '2025-12-31', TIMESTAMP '2026-01-01'),
        ('gone', CAST(NULL AS TIMESTAMP), TIMESTAMP '2026-01-01') AS t(g, updated, scored_at)""")
    rows = {r.g: r for r in stale_scores(then, now, dated, "2026-01-02 00:00:00", ["g"]).collect()}
    assert {g: r.reason for g, r in rows.items()} == {"a": "drift,age", None: None, "gone": "drift", "new": "drift"}
    assert not rows[None].stale and rows["new"].timeliness_now is None
    whole = [s.groupBy("column", "value").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n") for s in (then, now)]
    one = stale_scores(*whole, dated.where("g = 'a'").drop("g"), "2020-01-03 00:00:00", max_drift=0.9).collect()
    assert [(r.n_then, r.n_now, r.stale) for r in one] == [(5, 7, False)]
    assert stale_scores(then.where("false"), now.where("false"), dated, "2026-01-02 00:00:00", ["g"]).collect() == []
