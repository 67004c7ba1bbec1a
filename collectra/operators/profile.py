"""Long views of a table of text columns, and the profiles built on them."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import top_rows

# FIXED VALUES: id column names, in order of preference.
ID_NAMES = [
    "record_id", "id", "identifier", "signatur", "inventarnummer",
    "inventar_nr", "inv_nr", "object_id", "obj_id", "catalogue_id",
]


#: Longer values are counted by hash.
SHORT = 256


def quoted(name: str) -> str:
    return f"`{name}`"


def unused(name: str, df: DataFrame) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def cells(df: DataFrame, id_column: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per cell: ``(record_id, column, value)``. The id column itself
    is a cell, too, unless ``columns`` leaves it out."""
    columns = columns or df.columns
    record = F.col(quoted(id_column)).cast("string") if id_column else F.lit(None).cast("string")
    wide = df.select(record.alias("_record"), *[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    return wide.unpivot(
        ["_record"], [quoted(c) for c in columns], "column", "value"
    ).withColumnRenamed("_record", "record_id")


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, cnt)``. One scan and one shuffle for any number of
    columns; a dominant value or null collapses in the map-side count."""
    return cells(df, None, columns).groupBy("column", "value").agg(F.count("*").alias("cnt"))


def value_counts(df: DataFrame, columns: list[str] | None = None, whole: tuple[str, ...] = (), marks: dict[str, Column] | None = None) -> DataFrame:
    """``(column, key, size, value, marks, cnt)``: distinct values like :func:`frequencies`, but what
    is shuffled does not grow with the cells: a value is told by its 128-bit hash, and is
    itself kept only up to ``SHORT`` characters or in the columns ``whole``. ``size`` is its
    length (null for a gap), ``marks`` a number with one bit per condition that holds."""
    value, size = F.col("value"), F.length("value")
    keep = (size <= SHORT) | F.col("column").isin(*whole)
    bits = reduce(lambda x, y: x.bitwiseOR(y), [F.when(test, F.lit(1 << i)).otherwise(0) for i, test in enumerate((marks or {}).values())], F.lit(0))
    # conditions on values that are kept are asked of the distinct values only
    row = [
        "column", F.unhex(F.md5("value")).alias("key"), size.alias("size"), F.when(keep, value).alias("value"),
        F.when(value.isNull() | keep, 0).otherwise(bits).alias("marks"),
    ]
    counted = cells(df, None, columns).select(*row).groupBy("column", "key", "size", "value", "marks").agg(F.count("*").alias("cnt"))
    return counted.withColumn("marks", F.when(value.isNotNull(), bits).otherwise(F.col("marks")))


def long_cells(df: DataFrame, whole: tuple[str, ...] = ()) -> DataFrame:
    """``(column, value)`` of the cells whose value :func:`value_counts` does not keep."""
    return cells(df).where((F.length("value") > SHORT) & ~F.col("column").isin(*whole)).select("column", "value")


def column_profile(freq: DataFrame) -> DataFrame:
    """Per column: counts, distinct values, fill rate and value lengths, from
    :func:`value_counts` or :func:`frequencies`."""
    size = F.col("size") if "size" in freq.columns else F.length("value")
    filled = size.isNotNull()
    return (
        freq.groupBy("column")
        .agg(
            F.sum("cnt").alias("total_count"),
            F.sum(F.when(filled, F.col("cnt")).otherwise(0)).alias("non_null_count"),
            F.count(size).alias("unique_count"),
            F.min(size).alias("min_length"),
            F.max(size).alias("max_length"),
            F.sum(F.when(filled, size.cast("long") * F.col("cnt"))).alias("_chars"),
        )
        .withColumn("fill_rate", F.col("non_null_count") / F.col("total_count"))
        .withColumn("mean_length", F.floor(F.col("_chars") / F.col("non_null_count")).cast("int"))
        .drop("_chars")
    )


def sample_values(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` smallest distinct values of each column, as ``(column, pos, value)``. They lie among
    the values with the ``n`` smallest beginnings of ``SHORT`` characters, so only
    these are compared as a whole."""
    filled = cells(df).where(F.col("value").isNotNull()).select("column", "value", F.substring("value", 1, SHORT).alias("head"))
    heads = top_rows(filled.select("column", "head").distinct(), ["column"], [F.col("head")], n).select("column", "head")
    near = filled.join(F.broadcast(heads), ["column", "head"], "left_semi")  # n rows per column
    return top_rows(near.select("column", "value").distinct(), ["column"], [F.col("value")], n, "pos").select("column", "pos", "value")


def fill_rates(df: DataFrame) -> DataFrame:
    """``(column, total_count, filled_count, fill_rate)`` without any distinct count."""
    return (
        cells(df)
        .groupBy("column")
        .agg(F.count("*").alias("total_count"), F.count("value").alias("filled_count"))
        .withColumn("fill_rate", F.when(F.col("total_count") > 0, F.col("filled_count") / F.col("total_count")).otherwise(0.0))
    )


def id_candidates(profile: DataFrame, column_order: list[str]) -> DataFrame:
    """Columns whose values are all different, best candidate first in ``rank``.
    Known names come first in list order, then table order."""
    names = F.array(*[F.lit(n) for n in ID_NAMES])
    order = F.array(*[F.lit(c) for c in column_order])
    named = F.array_position(names, F.lower("column"))
    unique = F.col("unique_count") == F.col("non_null_count")
    return (
        profile.where(unique & ((F.col("non_null_count") > 0) | (named > 0)))
        .withColumn("rank", F.when(named > 0, named).otherwise(F.lit(1000) + F.array_position(order, F.col("column"))))
        .select("column", "rank", "unique_count")
    )


def detect_id_column(profile: DataFrame, column_order: list[str]) -> str | None:
    """The best id candidate; reads one row of a frame with one row per column."""
    best = id_candidates(profile, column_order).orderBy("rank").select("column").first()
    return best[0] if best else None


def id_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Row, value and distinct counts of a chosen id column; two-level count, so
    a repeated id is no hot spot."""
    per_value = df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count("*").alias("cnt"))
    return per_value.agg(
        F.sum("cnt").alias("row_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("cnt")).otherwise(0)).alias("value_count"),
        F.count("value").alias("distinct_count"),
    ).withColumn("is_unique", F.col("value_count") == F.col("distinct_count"))


def use_record_id(df: DataFrame, column: str) -> DataFrame:
    """Rename the id column to ``record_id``; refuse to overwrite another one."""
    if column == "record_id":
        return df
    if "record_id" in df.columns:
        raise ValueError(f"cannot rename {column!r}: the table already has a record_id column")
    return df.withColumnRenamed(column, "record_id")


@dataclass
class Dataset:
    """A named table of text columns with what is known about its file."""

    name: str
    df: DataFrame
    id_column: str | None
    has_bom: bool = False
    line_ending: str = ""
    encoding: str = "utf-8"

    def profile(self) -> DataFrame:
        return column_profile(value_counts(self.df)).withColumn("dataset", F.lit(self.name))


def dataset(name: str, df: DataFrame, id_column: str | None = None, **facts) -> Dataset:
    """Wrap a table; the id column is detected when it is not given."""
    found = id_column or detect_id_column(column_profile(value_counts(df)), df.columns)
    return Dataset(name, df, found, **facts)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep columns with at least one value; one aggregate row decides."""
    counts = df.agg(*[F.count(quoted(c)).alias(c) for c in df.columns]).first()
    return df.select(*[quoted(c) for c in df.columns if counts[c] > 0])


def facet_columns(freq: DataFrame, max_values: int = 40) -> DataFrame:
    """Each non-empty column with its kind: ``facet`` (few, repeated values) or ``text``."""
    some = F.col("size") > 0
    counts = freq.where(some).groupBy("column").agg(F.count("*").alias("distinct_values"), F.sum("cnt").alias("non_empty"))
    is_facet = (F.col("distinct_values") <= max_values) & (F.col("distinct_values") < F.col("non_empty"))
    return counts.withColumn("kind", F.when(is_facet, "facet").otherwise("text"))
