"""The state of a project as a folder of Parquet tables."""
from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .files import list_files


def save_workspace(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(os.path.join(path, name))


def load_workspace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = sorted({os.path.basename(os.path.dirname(f)) for f in list_files(spark, path)})
    return {n: spark.read.parquet(os.path.join(path, n)) for n in names}


# FIXED VALUES: the lists of a project document with the fields of their items, and its single fields.
LISTS = {
    "dictionary": "term string, entry_id string, entity_type string, preferred_name string, record_ids array<string>, gnd_id string, "
                  "gnd_preferred string, gnd_type string, gnd_uri string, wikidata_id string, wikidata_preferred string, wikidata_type string, "
                  "wikidata_uri string, geonames_id string, geonames_preferred string, geonames_type string, geonames_uri string, "
                  "alternatives array<string>, confidence double, source string, note string, term_normalized string, term_source string, "
                  "model_source string, last_edited string",
    "entity_reviews": "text string, entity_type string, record_id string, status string, confidence double, source string, gnd_id string, gnd_preferred string",
    "dates": "original string, edtf string, confidence double, method string, record_id string, column string, note string",
    "tasks": "task_id string, title string, description string, category string, status string, priority int, mds_field string, goobi_type string, "
             "csv_column string, fill_rate double, record_count long, suggestion string, created_at string, completed_at string, note string",
    "custom_mds_fields": "mds_name string, goobi_type string, requirement string, note string",
    "ai_runs": "task string, model string, total long, succeeded long, duration double",
    "image_analyses": "image_id string, filename string, record_id string, review_status string, result string",
    "authority_candidates": "entry_id string, candidate_id string, source string, authority_id string, preferred_name string, authority_type string, "
                            "uri string, score double, extra map<string,string>, status string, reviewer_note string, reviewed_at string, model string, "
                            "extracted_at string, reviewer string",
}
FIELDS = "name string, created_at string, updated_at string, source_file string, source_files array<string>, id_column string, base_url string, notes string, model_text string, model_vision string"
DEFAULTS = {
    "dictionary": {"confidence": 1.0, "source": "manual"}, "entity_reviews": {"status": "pending"},
    "authority_candidates": {"score": 0.0, "status": "pending"}, "project": {"id_column": "record_id"},
}


def _fields(schema: str, source: str, table: str = "") -> list[Column]:
    """The fields of a variant as columns; one that is missing or of another type is null, or its default."""
    out = []
    for name, kind in (f.split(" ") for f in schema.split(", ")):
        found = F.try_variant_get(source, F.lit(f"$.{name}"), kind) if kind != "string" else _text(F.try_variant_get(source, F.lit(f"$.{name}"), "variant"))
        default = DEFAULTS.get(table, {}).get(name)
        out.append((found if default is None else F.coalesce(found, F.lit(default))).alias(name))
    return out


def _text(value: Column) -> Column:
    """A variant as text: strings as they are, everything else as JSON."""
    return F.coalesce(F.try_variant_get(value, F.lit("$"), "string"), F.when(~F.is_variant_null(value), F.to_json(value)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document, doc)``: JSON documents below a path as variants, by their place below it without
    suffix. What is no JSON is left out."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    root = re.sub(r"^\w+:/*", "/", path.rstrip("/"))
    file = F.url_decode("_metadata.file_path")
    below = F.when(file.endswith(root), F.substring_index(file, "/", -1)).otherwise(F.substring_index(file, f"{root}/", -1))
    return raw.select(F.regexp_replace(below, r"\.[^./]*$", "").alias("document"), F.try_parse_json("value").alias("doc")).where("doc IS NOT NULL")


def items(docs: DataFrame, name: str) -> DataFrame:
    """``(document, ord, key, item)``: one row per element of a list or object of each document."""
    spark = docs.sparkSession
    return spark.sql(
        "SELECT document, e.pos AS ord, e.key AS key, e.value AS item FROM {docs}, LATERAL variant_explode(try_variant_get(doc, :place, 'variant')) AS e",
        args={"place": f"$.{name}"}, docs=docs)


def import_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of projects kept as JSON documents: one row per list item, with its document, its place, its
    fields as columns and, as ``item``, all of it as JSON, so that fields nobody knows of stay.

    The dictionary may be a list or an object of entries, field mappings a list of
    objects or a plain map from column to target type; ``extras`` keeps each entry as JSON and
    ``project`` the single fields. Each document is parsed once, as a variant."""
    docs = cut_lineage(documents(spark, path))
    out = {}
    for name, schema in LISTS.items():
        rows = items(docs, name)
        out[name] = rows.select("document", *_fields(schema, "item", name), "ord", F.to_json("item").alias("item"))
    mapping = items(docs, "field_mapping")
    kind = "csv_column string, goobi_type string, label string, repeatable boolean, authority string, enabled boolean"
    listed = mapping.select("document", "ord", "key", "item", *_fields(kind, "item"))
    out["field_mapping"] = listed.select(
        "document", F.coalesce("key", "csv_column").alias("source_column"), F.when(F.col("key").isNotNull(), _text(F.col("item"))).otherwise(F.col("goobi_type")).alias("target_type"),
        F.coalesce("label", F.lit("")).alias("label"), F.coalesce("repeatable", F.lit(False)).alias("repeatable"), F.coalesce("authority", F.lit("")).alias("authority"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"), "ord")
    out["extras"] = items(docs, "extras").select("document", "key", F.to_json("item").alias("item"))
    out["project"] = docs.select("document", *_fields(FIELDS, "doc", "project"))
    return out


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [t.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).select("name", "n")
