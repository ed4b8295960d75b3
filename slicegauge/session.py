"""Session settings, size checks and lineage cuts shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Inputs whose optimizer size estimate stays below this take the one-shuffle
# form of an operator (for example one `percentile` map per group); anything
# larger, or of unknown size, takes the form whose tasks stay bounded.
SMALL_BYTES = 64 * 1024 * 1024


def build_session(app: str = "slicegauge", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC and AQE."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; runs no job.

    For file scans it is the compressed size of the files, and an explode does
    not raise it. So it only picks between forms that give the same rows.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return plan_bytes(df) <= (SMALL_BYTES if limit is None else limit)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`, whatever store it is in.

    Only a session in one JVM, as in tests, may leave it unset and then uses a
    folder beside its warehouse. On a cluster that would be out of reach of the
    other machines, so there it must be named.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoint"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_TABLES: list[str] = []


def new_table(spark: SparkSession) -> str:
    """Path of a table to be written in the shared folder."""
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage of a frame that several branches or jobs read.

    Written to the shared checkpoint folder as a table and read back, so it
    survives lost executors and Catalyst knows its true size from then on.
    With `partition_by`, reading one value of that column reads its files only.
    """
    path = new_table(df.sparkSession)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables written to the shared folder; call it when their readers are done."""
    paths = list(_TABLES)
    _TABLES.clear()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
