"""Image files as tables: technical facts and links to records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from .joins import lookup_join


def link_records(records: DataFrame, path_column: str, images: DataFrame, name_column: str = "filename") -> DataFrame:
    """Each record with the image whose file name its path ends in; either
    slash, case ignored; records without an image are kept. Of several images
    with one name the last counts (by ``ord``, else by their full name)."""
    left = records.withColumn("_name", F.nullif(base_name(F.col(path_column)), F.lit("")))
    taken = [c for c in images.columns if c not in records.columns]
    named = images.withColumn("_name", F.nullif(base_name(F.col(name_column)), F.lit(""))).where("_name IS NOT NULL")
    order = F.struct(*[F.col(c) for c in ("ord", name_column) if c in images.columns])
    right = named.groupBy("_name").agg(F.max_by(F.struct(*taken), order).alias("_image")).select("_name", "_image.*")
    return lookup_join(left, right, ["_name"], "left").drop("_name")


def link_counts(linked: DataFrame, image_column: str = "image_id") -> DataFrame:
    return linked.agg(F.count(image_column).alias("matched"), F.count("*").alias("total"))
