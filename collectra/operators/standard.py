"""Validation against a field standard, and the tasks that follow from gaps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join
from .profile import fill_rates

MAPPING = "source_column string, target_type string, label string, repeatable boolean, authority string, enabled boolean, ord int"

# FIXED VALUES: fields of the minimum data standard 1.1 (name, target type, requirement).
STANDARD_FIELDS = [
    ("Identifikator", "CatalogIDDigital", "required"),
    ("Titel", "TitleDocMain", "required"),
    ("Objekttyp", "DocStruct", "required"),
    ("Aufbewahrungsort", "PlaceOfPublication", "required"),
    ("Rechtliche Informationen", "Rights", "required"),
    ("Beschreibung", "Description", "recommended"),
    ("Datierung", "DateCreated", "recommended"),
    ("Abmessungen/Umfang", "Dimensions", "recommended"),
    ("Material/Technik", "MaterialDescription", "recommended"),
    ("Hersteller/Urheber", "Creator", "recommended"),
    ("Abbildungsnachweis", "Source", "recommended"),
    ("Schlagwörter", "SubjectTopic", "recommended"),
    ("Herstellungsort", "SubjectGeographic", "recommended"),
    ("Sammlung", "singleDigCollection", "recommended"),
]


def standard_fields(spark, custom: list[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = [(*f, i) for i, f in enumerate([*STANDARD_FIELDS, *(custom or [])])]
    return spark.createDataFrame(rows, "field string, target_type string, requirement string, ord int")


def validate(df: DataFrame, mappings: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """One row per field: mapped column, filled and total records. The last
    enabled mapping of a target type counts. Only one pass over ``df``; all
    joined frames have one row per field or column."""
    fields = fields if fields is not None else standard_fields(df.sparkSession)
    chosen = mappings.where(F.col("enabled") & (F.col("source_column") != "")).groupBy("target_type").agg(
        F.max_by("source_column", "ord").alias("source_column")
    )
    from ..functions.text import has_text

    from .profile import cells

    filled = cells(df).groupBy("column").agg(
        F.count("*").alias("record_count"), F.count_if(has_text(F.col("value"))).alias("filled_count")
    )
    size = filled.agg(F.max("record_count").alias("total")).withColumn("_k", F.lit(1))
    out = (
        fields.join(F.broadcast(chosen), "target_type", "left")
        .join(F.broadcast(filled.withColumnRenamed("column", "source_column").drop("record_count")), "source_column", "left")
        .withColumn("_k", F.lit(1)).join(F.broadcast(size), "_k")  # one row
    )
    count = F.coalesce("filled_count", F.lit(0))
    return out.select(
        "ord", "field", "target_type", "requirement", F.col("source_column").isNotNull().alias("mapped"),
        F.coalesce("source_column", F.lit("")).alias("source_column"), count.alias("filled_count"), F.col("total").alias("record_count"),
        F.when(F.col("total") > 0, count / F.col("total")).otherwise(0.0).alias("fill_rate"),
    )


def score(results: DataFrame) -> DataFrame:
    """Required fields mapped and filled; fill rates weighted 2 / 1 / 0.5."""
    required = F.col("requirement") == "required"
    weight = F.when(required, 2.0).when(F.col("requirement") == "recommended", 1.0).otherwise(0.5)
    return results.agg(
        F.count_if(required & F.col("mapped")).alias("required_mapped"), F.count_if(required).alias("required_total"),
        F.count_if(required & (F.col("fill_rate") > 0)).alias("required_filled"),
        F.coalesce(F.sum(F.when(F.col("mapped"), F.col("fill_rate") * weight).otherwise(0.0)) / F.sum(weight), F.lit(0.0)).alias("completeness_score"),
    )


def tasks(results: DataFrame) -> DataFrame:
    """Unmapped, empty and half-filled fields as tasks, most urgent first."""
    required = F.col("requirement") == "required"
    unmapped, empty = ~F.col("mapped"), F.col("fill_rate") == 0
    open_ = results.where(unmapped | (F.col("fill_rate") < 0.5))
    lack = F.when(unmapped | empty, F.col("record_count")).otherwise(F.col("record_count") - F.col("filled_count"))
    title = F.when(unmapped, "Feld zuordnen: ").when(empty, "Daten ergänzen: ").otherwise("Lücken schließen: ")
    return open_.select(
        F.sha2(F.concat_ws("|", "field", F.when(unmapped, "map_field").otherwise("fill_data")), 256).alias("task_id"),
        F.concat(title, "field").alias("title"), F.when(unmapped, "map_field").otherwise("fill_data").alias("category"),
        F.lit("open").alias("status"),
        F.when(unmapped, F.when(required, 0).otherwise(3)).when(empty, F.when(required, 1).otherwise(4))
        .otherwise(F.when(required, 2).otherwise(4)).alias("priority"),
        "field", "target_type", "source_column", "fill_rate", lack.alias("record_count"), "ord",
    ).orderBy("priority", "ord")


def add_new_tasks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing tasks, then those without a task for the same field and category."""
    fresh = lookup_join(new, existing.select("field", "category").distinct(), ["field", "category"], "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
