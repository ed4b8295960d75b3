"""Append-once tables for foreachBatch: one folder per batch, replaced on a retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write a micro-batch; a batch that is run again replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def last_state(spark: SparkSession, path: str, batch: int, schema: str) -> list:
    """Rows that the batch before this one left; batches are numbered without gaps from 0."""
    return spark.read.schema(schema).parquet(f"{path}/batch={batch - 1}").collect() if batch else []


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch")
