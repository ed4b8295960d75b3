"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# A word is a run of anything but the six ASCII white-space bytes, which is
# also what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


# Rows handed to Python at once; texts may be long, and a batch is held whole.
BATCH_ROWS = "1000"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_bytes(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ranked(df: DataFrame, order: list[Column], name: str = "rank", add: dict[str, str] | None = None) -> DataFrame:
    """`df` (few narrow columns) with its gapless position from 0 in `order`, and running sums.

    `add` maps a new column to the numeric column whose sum over all earlier
    rows it gets. Rows are dealt into ranges, every range counts itself, and the
    ranges' starts come from those counts; no task sees more than one range.
    Rows equal in all of `order` fall into one range. The ranges are written to
    the shared folder, so a lost executor cannot deal them anew.
    """
    add = add or {}
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_parts(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(c).alias(f"_s{i}") for i, c in enumerate(add.values())])
    # one row per shuffle partition, so this window stays small at any input size
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}")
                                      for c in ["_n", *[f"_s{i}" for i in range(len(add))]]])
    inside = Window.partitionBy("_range").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_range")
    out = out.withColumn(name, F.row_number().over(inside) - 1 + F.col("_b_n"))
    for i, (new, c) in enumerate(add.items()):
        out = out.withColumn(new, F.coalesce(F.sum(c).over(running), F.lit(0)) + F.col(f"_b_s{i}"))
    return out.drop("_range", "_b_n", *[f"_b_s{i}" for i in range(len(add))])
