"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, so that further
    columns cannot clash. A null text counts as empty."""
    return df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()


def by_crc(df: DataFrame, column: str, modulo: int):
    """``crc32`` of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulo
