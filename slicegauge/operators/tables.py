"""Table shaping around runs and features: flat tables, grids, pivots, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F



def flat_table(fact: DataFrame, dimension: DataFrame, on: tuple[str, str], detail: DataFrame,
               detail_on: tuple[str, str], count_name: str) -> DataFrame:
    """Fact rows with their dimension and the number of detail rows (0 if none).

    Details are counted before the join, so a key with very many of them
    collapses map-side.
    """
    dim = dimension.withColumnRenamed(on[1], on[0]) if on[1] != on[0] else dimension
    counts = (detail.groupBy(F.col(detail_on[1]).alias(detail_on[0]))
              .agg(F.count(F.lit(1)).alias(count_name)))
    out = fact.join(dim, on[0], "left").join(counts, detail_on[0], "left")
    return out.withColumn(count_name, F.coalesce(count_name, F.lit(0)))


def run_grid(slices: DataFrame, models: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Every slice with each model family and seed; the lists are configuration."""
    return (slices.withColumn("model_family", F.explode(F.array(*[F.lit(m) for m in models])))
            .withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))))


def pending_runs(grid: DataFrame, done: DataFrame,
                 keys: Sequence[str] = ("slice", "model_family", "seed")) -> DataFrame:
    """Grid rows without a result yet."""
    return grid.join(done.select(*keys), list(keys), "left_anti")


def status_counts(runs: DataFrame, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    return runs.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))


def counts_pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[Any]) -> DataFrame:
    """Row counts with one column per listed value, 0 where none."""
    return df.groupBy(*rows).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def means_pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[Any], measure: str) -> DataFrame:
    """Means with one column per listed value, NULL where none."""
    return df.groupBy(*rows).agg(*[
        F.avg(F.when(F.col(column) == v, F.col(measure))).alias(f"mean_{v}") for v in values])


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All frames under one another with a column naming the origin; columns by name."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def run_records(records: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Split run records into a metric table of finished runs and the failed rest."""
    cols = ["slice", "model_family", "seed", "harm_content_density", "S_composite", "Q_composite",
            "mc1", "mc2", "n_questions", "train_seconds"]
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    have = [c for c in cols if c in records.columns]
    return (records.where(ok).select(F.lit(dataset).alias("dataset"), *have), records.where(~ok))


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, content_hash): an order-free hash of all rows.

    Decimal sum of 64-bit md5 prefixes of the rows' text forms; equal contents
    give equal sums whatever the order or partitioning. Fields carry their
    byte length, so NULLs and separators inside a text cannot be mistaken.
    """
    texts = [F.col(c).cast("string") for c in df.columns if c not in by]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    part = F.conv(F.substring(F.md5(F.concat(*fields)), 1, 16), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("content_hash"))
