"""The incremental forms, drained, equal the batch forms."""

from pyspark.sql import functions as F

from slicegauge.functions.text import url_category
from slicegauge.operators.sampling import quota_per_category
from slicegauge.streaming import ledger, quotas

CATS = {"www": [r"//www\."], "blog": [r"//blog\."], "mobile": [r"//m\."]}


def _pages(spark, folder, path, files=5):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    ids = [r.page_id for r in pages.select("page_id").orderBy("page_id").collect()]
    step = -(-len(ids) // files)
    for i in range(0, len(ids), step):
        lo, hi = ids[i], ids[min(i + step, len(ids)) - 1]
        pages.where(F.col("page_id").between(lo, hi)).coalesce(1).write.parquet(f"{path}/part{i // step}")
    return pages


def test_quotas_match_batch(spark, data, tmp_path):
    src = str(tmp_path / "src")
    pages = _pages(spark, data, src)
    for cap in (None, 120):
        out = str(tmp_path / f"out{cap}")
        stream = (spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*"))
        # files carry increasing ids; the source reads them oldest first
        q = quotas.fill_quotas(stream, url_category(F.col("url"), CATS), "page_id", list(CATS), 20, out,
                               str(tmp_path / f"chk{cap}"), cap)
        q.awaitTermination(120)
        assert quotas.read_table(spark, out + "_counts").where("category IS NULL").count() == 5
        want = quota_per_category(pages, url_category(F.col("url"), CATS), "page_id", list(CATS), 20, cap)
        got = quotas.read_table(spark, out)
        assert sorted(r.page_id for r in got.collect()) == sorted(r.page_id for r in want.collect())


def test_ledger_runs_twice(spark, tmp_path):
    src, out, chk = [str(tmp_path / x) for x in ("src", "out", "chk")]
    schema = "slice string, model_family string, seed int, mc1 double, status string"
    rows = [[("s", "m", 1, 0.5, "ok"), ("s", "m", 2, None, "failed"), ("s", "m", 2, 0.7, "ok")], [("s", "m", 1, 0.9, "ok"), ("s", "m", 3, 0.1, "ok")]]

    def run():
        stream = spark.readStream.schema(schema).json(src)
        ledger.record_runs(stream, out, chk).awaitTermination(120)
        return sorted((r.seed, r.mc1, r.status) for r in ledger.read_table(spark, out).collect())
    spark.createDataFrame(rows[0], schema).write.json(src)
    first = run()
    assert first == [(1, 0.5, "ok"), (2, 0.7, "ok")] == run()
    spark.createDataFrame(rows[1], schema).write.mode("append").json(src)
    assert run() == [(1, 0.5, "ok"), (2, 0.7, "ok"), (3, 0.1, "ok")]


def test_ledger_reads_new_rows_only(spark, tmp_path):
    """Nulls and exact values survive, repeats are dropped by state, and no batch reads what is recorded."""
    src, out, chk = [str(tmp_path / x) for x in ("src", "out", "chk")]
    schema = "slice string, model_family string, seed int, at timestamp, n long, status string"
    for i in range(3):
        spark.sql(f"""SELECT IF(id = 0, NULL, 's' || id) AS slice, 'm' AS model_family, CAST({i} + id % 2 AS INT) AS seed,
            TIMESTAMP '2024-01-01 00:00:00.123456' AS at, 9007199254740993 + {i} AS n, 'ok' AS status FROM range(4)""").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = ledger.record_runs(stream, out, chk)
        q.awaitTermination(120)
        assert sum(p["numInputRows"] for p in q.recentProgress) == 4
    rows = ledger.read_table(spark, out).collect()
    assert len(rows) == len({(r.slice, r.seed) for r in rows}) == 12 and {str(r["at"])[-6:] for r in rows} == {"123456"}
    assert {r.n for r in rows} == {9007199254740993 + i for i in range(3)} and sum(r.slice is None for r in rows) == 3
    stream = spark.readStream.schema(schema).parquet(src)
    spark.read.parquet(out).limit(5).select("slice", "model_family", "seed", "at", "n", "status").write.mode("append").parquet(src)
    ledger.record_runs(stream, out, chk).awaitTermination(120)
    assert ledger.read_table(spark, out).count() == 12
