"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "collectra", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it in ``spark.checkpoint.dir``.
    Where that is unset, only a local session (tests) gets a temporary folder;
    anything else is an error, since executors would not share it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a table or file at this path, in whatever store it names?"""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def cut_lineage(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back. The rows survive
    lost executors, are computed once, and the next plan knows their size. Row groups
    of few bytes let many tasks read what one task has written."""
    path = scratch_path(df.sparkSession, "table")
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", str(row_group)) if row_group else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
