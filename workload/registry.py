"""Query registry and small helpers for reading the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2026-06-09 00:00:00"


class Tables:
    """Attribute access to the parquet tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register `fn(tables)` under a name, with the SQL that must give the same rows."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # ages and timestamps are compared in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def rounded(*columns: str, digits: int = 8) -> list[str]:
    """Select items that round doubles and drop negative zeros."""
    return [f"round({c}, {digits}) + 0.0D AS {c}" for c in columns]


def rounded_sql(*columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
