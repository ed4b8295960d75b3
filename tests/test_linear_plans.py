"""Repeated splits and joins with a few groups' results neither multiply nor shuffle the rows."""

import pytest
from pyspark.sql import functions as F

from workload import QUERIES
from slicegauge.operators.ranking import hash_cell, hash_marked, hash_marked_all
from slicegauge.operators.sampling import stratified_split, stratified_splits
from slicegauge.session import materialize


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("small", [None, 0])
def test_five_splits_read_the_rows_once(spark, data, small):
    """nested splits doubled the plan with every seed."""
    rows = spark.read.parquet(f"{data}/lineitem.parquet").select("l_returnflag", "l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"))
    flags = stratified_splits(rows, "l_linestatus", "key", range(5), [f"t{s}" for s in range(5)], 0.2, ["l_returnflag"], small)
    one = stratified_split(rows, "l_linestatus", "key", 3, 0.2, ["l_returnflag"], small_bytes=small)
    assert flags.where("t3").select("key").exceptAll(one.where("is_test").select("key")).isEmpty()
    scans = [p for p in plan_of(flags).split("Relation [")[1:] if "l_orderkey" in p.split("\n")[0]]
    assert len(scans) == 1
    sizes = flags.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"t{s}").alias(f"t{s}") for s in range(5)]).collect()
    assert sizes and all(r[f"t{s}"] == round(r.n * 0.2) for r in sizes for s in range(5))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_flags_count_full_ties_exactly(spark, by):
    """Rows that equal each other in draw key and tie are flagged up to the limit, in both forms."""
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, NULL, 'a') AS g", "md5(CAST(id % 4 AS STRING)) AS k", "id % 2 AS t")
    for limit in (F.lit(0), F.lit(7), F.floor(F.col("__n") / 3), F.col("__n")):
        forms = [sorted(map(tuple, hash_marked(rows, by, "k", limit, ["t"], "f", s).groupBy(*by, "k", "t", "f").count().collect()), key=repr) for s in (None, 0)]
        assert forms[0] == forms[1]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("limit", ["0", "7", "floor(__n / 3)", "__n"])
def test_flags_of_several_keys_at_once(spark, by, limit):
    """each key's flags are those it gets alone, full ties, missing groups and ties included."""
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, NULL, 'a') AS g", "md5(CAST(id % 4 AS STRING)) AS k0", "md5(CAST(id % 400 AS STRING)) AS k1", "nullif(id % 2, 1) AS t")
    marks = [(f"f{i}", F.col(f"k{i}")) for i in range(2)]
    held = rows.withColumns({f"c{i}": hash_cell(F.col(f"k{i}")) for i in range(2)})
    both, given = hash_marked_all(rows, by, marks, F.expr(limit), ["t"]), hash_marked_all(held, by, marks, F.expr(limit), ["t"], ["c0", "c1"])
    assert both.columns == [*rows.columns, "f0", "f1"] and given.columns == [*held.columns, "f0", "f1"] and both.count() == given.count() == 1000
    for i in range(2):
        want = hash_marked(rows, by, f"k{i}", F.expr(limit), ["t"], "f").groupBy(*by, f"k{i}", "t", "f").count()
        for got in (both, given):
            assert want.exceptAll(got.groupBy(*by, f"k{i}", "t", F.col(f"f{i}").alias("f")).count()).isEmpty()


def test_splits_of_many_seeds_write_no_more(spark, data, monkeypatch):
    """the cells of every seed were counted and ranked in reads of their own."""
    written = []

    def kept(df):
        written.append(df)
        return materialize(df)

    monkeypatch.setattr("slicegauge.operators.ranking.materialize", kept)
    monkeypatch.setattr("slicegauge.session.SMALL_BYTES", 0)
    rows = spark.read.parquet(f"{data}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    for seeds in (1, 5):
        stratified_splits(rows, "o_orderstatus", "o_orderkey", range(seeds), [f"t{s}" for s in range(seeds)], 0.2, ["o_orderpriority"])
        assert len(written) == 4
        written.clear()


@pytest.mark.parametrize("name", ["bootstrap_rows_ci", "free_of_error_lineitem", "nmi_pairs", "score_slices"])
def test_rows_meet_their_group_by_broadcast(spark, data, monkeypatch, name):
    """F4 to F11: rows were shuffled and sorted by a few group keys, a whole group in one task."""
    monkeypatch.setattr("slicegauge.session.SMALL_BYTES", 0)
    written = []  # the bootstrap writes its block sums, behind which no row is left

    def kept(df):
        written.append(df)
        return materialize(df)

    monkeypatch.setattr("slicegauge.operators.stats.materialize", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")
    try:
        out = QUERIES[name](spark, data)
        plan = (written or [out])[0]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_spearman_writes_its_ranks(spark, data, monkeypatch):
    """the ranks were worked out inside the joins, so that few ranks of many rows were not known to be few."""
    monkeypatch.setattr("slicegauge.session.SMALL_BYTES", 0)
    plan = QUERIES["safe_spearman"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
