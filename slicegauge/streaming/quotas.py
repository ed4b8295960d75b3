"""Fill per-category row quotas from a stream, in arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import sql
from ..operators.ranking import first_rows, ranked, with_value_bucket
from .tables import last_state, read_table, write_batch


def fill_quotas(stream: DataFrame, category: Column, order: str, categories: Sequence[str], n: int,
                path: str, checkpoint: str, read_cap: int | None = None) -> StreamingQuery:
    """Start a query that tops up a quota table from each micro-batch.

    Every batch sees how many rows each category already has and how many
    rows were read before it, and adds only the missing first rows. These
    counters are handed from batch to batch beside the table (`_counts`), so a
    batch reads one small file and never the rows taken earlier. Drained,
    the table equals `quota_per_category` of the same rows. All rows are read
    unless the caller sets a cap.
    """
    names = [*stream.columns, "category"]

    def top_up(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            counts = {r["category"]: r["n"] for r in last_state(spark, path + "_counts", number, "category string, n long")}
            seen = counts.pop(None, 0)
            size = batch.count()
            left = size if read_cap is None else max(0, read_cap + 1 - seen)
            rows = first_rows(batch, left, order) if size > left else batch
            # one number per listed category
            open_ = {c: n - counts.get(c, 0) for c in categories if counts.get(c, 0) < n}
            rows = rows.withColumn("category", category).where(F.col("category").isin(*open_))
            limit = F.expr(sql.choose("category", open_, "0"))
            keyed = with_value_bucket(rows.withColumn("__v", F.col(order).cast("double")), ["category"], "__v", "__vb")
            fresh = ranked(keyed, ["category"], [order], F.col("__vb"), "__r", limit).select(*names)
            write_batch(fresh, path, number)
            taken = spark.read.schema(fresh.schema).parquet(f"{path}/batch={number}").groupBy("category").count().collect()
            for r in taken:
                counts[r["category"]] = counts.get(r["category"], 0) + r["count"]
            state = [(None, seen + min(size, left)), *sorted(counts.items())]
            write_batch(sql.local_table(spark, state, ["category", "n"]).selectExpr("CAST(category AS STRING) AS category", "CAST(n AS BIGINT) AS n").coalesce(1),
                        path + "_counts", number)
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(top_up).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


__all__ = ["fill_quotas", "read_table"]
