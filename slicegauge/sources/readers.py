"""Readers: CSV dialects, Parquet, JSON records, score files, optional inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.scalars import blank_tokens
from ..plans.assess import explode_records

RUN_RECORD = ("slice string, model_family string, seed int, harm_content_density double, S_composite double, "
              "Q_composite double, mc1 double, mc2 double, n_questions long, train_seconds double, "
              "eval_seconds double, status string, error string")

_PROXY_DETAIL = "struct<applicable: boolean, raw_value: string, details: string>"
SCORE_FILE = ("dataset string, application string, n_slices int, slices array<struct<name: string, n_rows: long, "
              "Q: double, S: double, R: double, excluded_for_na: array<string>, per_sub_dimension: struct<"
              "quality: map<string, double>, safety: map<string, double>, rights: map<string, double>>, "
              f"details: map<string, {_PROXY_DETAIL}>, elapsed_seconds: double>>")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None,
             header: bool = True, sep: str = ",", names: Sequence[str] | None = None,
             null_tokens: Sequence[str] = (), trim: bool = False, partitions: int | None = None) -> DataFrame:
    """Delimited text. Without a schema types are inferred by one extra pass.

    `null_tokens` are read as missing (the reader itself knows only one);
    string columns holding such tokens need a schema if they should be
    numeric. `partitions` spreads a file that cannot be split, such as gzip.
    """
    r = spark.read.option("header", header).option("sep", sep)
    if trim:
        r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path if isinstance(path, str) else list(path))
    if names:
        df = df.toDF(*names)
    if null_tokens:
        df = blank_tokens(df, null_tokens, trim)
    return df.repartition(partitions) if partitions else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_records(spark: SparkSession, folder: str, schema: str = RUN_RECORD) -> DataFrame:
    """A folder with one JSON object per file."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Nested per-dataset score files as one row per slice."""
    return explode_records(spark.read.schema(SCORE_FILE).option("multiLine", True).json(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_available(spark: SparkSession, inputs: Mapping[str, Sequence[str]],
                   load: Callable[[SparkSession, str], DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load every dataset whose files are all there; report the others.

    `inputs` maps a dataset to the paths it needs, `load` reads one by name.
    Returns the frames and a (dataset, status, error) table.
    """
    frames, status = {}, []
    for name, paths in inputs.items():
        lost = [p for p in paths if not exists(spark, p)]
        if lost:
            status.append((name, "skipped", "missing: " + ", ".join(lost)))
            continue
        try:
            frames[name] = load(spark, name)
            status.append((name, "ok", None))
        except Exception as e:  # reported, the other datasets go on
            status.append((name, "failed", f"{type(e).__name__}: {e}"))
    return frames, spark.createDataFrame(status, "dataset string, status string, error string")
