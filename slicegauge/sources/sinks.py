"""Sinks: CSV tables, sliced Parquet, nested score and test records as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.assess import slice_records


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).csv(path, header=True)


def write_slices(df: DataFrame, path: str, mode: str = "overwrite", slice_: str = "slice") -> None:
    """One folder per slice. A slice spreads over several files, whatever its size."""
    df.write.mode(mode).partitionBy(slice_).parquet(path)


def write_scores(scores: DataFrame, application: str, path: str, by: Sequence[str] = ("dataset", "slice"),
                 mode: str = "overwrite") -> None:
    """One JSON line per slice under a folder per dataset."""
    records = slice_records(scores, application, by)
    records.write.mode(mode).partitionBy(*[b for b in by if b == "dataset"]).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
