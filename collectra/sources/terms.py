"""Problem-term lists from CSV, TXT and JSON files."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .files import head, list_files

# FIXED VALUES: words that mark a header row.
HEADERS = ["term", "begriff", "wort", "word"]
SCHEMA = "term string, replacement string, category string, note string"


def _finish(rows: DataFrame) -> DataFrame:
    """Trimmed terms, first entry of each lower-case form."""
    text = [F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in ("term", "replacement", "category", "note")]
    clean = rows.select(*text, "ord").where("term <> ''")
    return clean.groupBy(F.lower("term").alias("_k")).agg(F.min_by(F.struct(*clean.columns), "ord").alias("e")).select("e.*")


def read_csv_terms(spark: SparkSession, path: str) -> DataFrame:
    """``term[,replacement[,category[,note]]]``; a header line is skipped."""
    groups: dict[bool, list[str]] = {}
    for file in list_files(spark, path):
        first = head(spark, file).decode("utf-8-sig", "replace").partition("\n")[0].split(",")[0]
        groups.setdefault(first.strip().strip('"').strip().lower() in HEADERS, []).append(file)
    if not groups:
        raise FileNotFoundError(path)
    frames = [spark.read.schema(SCHEMA).options(header=skip, escape='"').csv(files) for skip, files in sorted(groups.items())]
    return _finish(reduce(DataFrame.unionByName, frames).withColumn("ord", F.monotonically_increasing_id()))


def read_json_terms(spark: SparkSession, path: str) -> DataFrame:
    """A list of words, a list of objects, or a map from word to replacement or object."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^﻿", "").alias("doc"))
    listed = files.where(F.ltrim("doc").startswith("[")).select(F.posexplode(F.from_json("doc", "array<string>")).alias("ord", "item"))
    keyed = files.where(F.ltrim("doc").startswith("{")).select(F.posexplode(F.map_entries(F.from_json("doc", "map<string,string>"))).alias("ord", "e"))

    def field(c: Column, *keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")) for k in keys])

    def entry(c: Column, term: Column, plain: Column) -> list[Column]:
        is_object = c.startswith("{")
        return [
            F.coalesce(F.when(is_object, field(c, "term")), term).alias("term"),
            F.when(is_object, field(c, "replacement", "ersatz")).otherwise(plain).alias("replacement"),
            F.when(is_object, field(c, "category", "kategorie")).alias("category"), F.when(is_object, field(c, "note", "hinweis")).alias("note"),
        ]

    item = F.col("item")
    from_list = listed.select(*entry(item, F.when(~item.startswith("{"), item), F.lit(None).cast("string")), F.col("ord").cast("long").alias("ord"))
    value = F.coalesce(F.col("e.value"), F.lit(""))
    from_map = keyed.select(*entry(value, F.col("e.key"), value), F.col("ord").cast("long").alias("ord"))
    return _finish(from_list.unionByName(from_map))
