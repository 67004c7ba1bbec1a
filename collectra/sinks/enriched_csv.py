"""The source table with entities, dates, image results and authority ids."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ENTITY_COLUMNS
from ..functions.text import has_text, strip
from ..operators.joins import fits_broadcast, lookup_join, ordered_text
from ..operators.profile import quoted

GLOBAL = ""


def labels(mentions: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """``(record_id, entity_type, label, ord)``: authority name if there is
    one, else the text. All review states by default."""
    rows = mentions.where(F.col("entity_type").isin(list(ENTITY_COLUMNS)))
    if statuses:
        rows = rows.where(F.col("status").isin(statuses))
    label = F.when(has_text(F.coalesce("gnd_preferred", F.lit(""))), F.col("gnd_preferred")).otherwise(F.col("text"))
    return rows.select(F.coalesce("record_id", F.lit(GLOBAL)).alias("record_id"), "entity_type", label.alias("label"), "ord")


def _pivot(joined: DataFrame, value: str, names: dict[str, str]) -> DataFrame:
    """One row per record; the code list is fixed, so no extra pass finds it."""
    wide = joined.groupBy("record_id").pivot("entity_type", list(names)).agg(F.first(value))
    return wide.select("record_id", *[F.col(code).alias(name) for code, name in names.items()])


def _with_global(df: DataFrame, wide: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Join per-record columns; an empty cell falls back to entities without a record."""
    own = wide.where(F.col("record_id") != GLOBAL).withColumnRenamed("record_id", "_rid")
    out = lookup_join(df.withColumn("_rid", F.col(quoted(id_column)).cast("string")), own, ["_rid"], "left").drop("_rid")
    shared = wide.where(F.col("record_id") == GLOBAL).select(F.lit(1).alias("_k"), *[F.col(c).alias(f"_g_{c}") for c in columns])
    if fits_broadcast(shared, 1):
        out = out.withColumn("_k", F.lit(1)).join(F.broadcast(shared), "_k", "left")
    else:  # one long row: a copy for each of many tasks
        spread = shared.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(255))))
        out = out.withColumn("_k", F.pmod(F.xxhash64(F.col(quoted(id_column))), F.lit(256)).cast("int")).join(spread, "_k", "left")
    filled = {c: F.coalesce(F.nullif(c, F.lit("")), F.col(f"_g_{c}"), F.lit("")) for c in columns}
    return out.withColumns(filled).drop("_k", *[f"_g_{c}" for c in columns])


def authority_ids(rows: DataFrame, terms: DataFrame, sep: str = "; ") -> tuple[DataFrame, DataFrame]:
    """Ids of the labels per (record, type) and per record, in label order.
    A label that holds the separator is looked up part by part."""
    parts = rows.select(
        "record_id", "entity_type", "ord", F.posexplode(F.split("label", F.lit("\\" + sep.strip()))).alias("pos", "part")
    ).withColumn("part", F.lower(strip(F.col("part"))))
    from .common import gnd_lookup

    hits = lookup_join(parts, gnd_lookup(terms), ["part"], "inner")
    position = F.array_position(F.array(*[F.lit(c) for c in ENTITY_COLUMNS]), F.col("entity_type"))
    hits = hits.withColumn("at", F.struct(position.alias("t"), "ord", "pos"))
    return ordered_text(hits, ["record_id", "entity_type"], "gnd_id", "at", "ids", sep), ordered_text(hits, ["record_id"], "gnd_id", "at", "gnd_ids", sep)


def edtf_columns(df: DataFrame, dates: DataFrame, id_column: str) -> DataFrame:
    """``edtf_<column>`` per dated column: by record id, last one wins; a table
    without that id column is matched by the original text."""
    named = dates.withColumn("source_column", F.coalesce(F.nullif("source_column", F.lit("")), F.lit("__date__")))
    columns = sorted(r[0] for r in named.select("source_column").distinct().collect())  # schema-sized
    if id_column in df.columns:
        known = named.where(has_text(F.col("edtf")) & has_text(F.coalesce("record_id", F.lit(""))))
        per = known.groupBy(F.col("record_id").alias("_rid")).pivot("source_column", columns).agg(F.max_by("edtf", "ord"))
        per = per.select("_rid", *[F.col(quoted(c)).alias(f"edtf_{c}") for c in columns])
        out = lookup_join(df.withColumn("_rid", F.col(quoted(id_column)).cast("string")), per, ["_rid"], "left").drop("_rid")
    else:
        out = df
        for c in columns:
            if c not in df.columns:
                out = out.withColumn(f"edtf_{c}", F.lit(""))
                continue
            by_text = named.where(F.col("source_column") == c).groupBy(F.col("original").alias("_v")).agg(F.max_by("edtf", "ord").alias(f"edtf_{c}"))
            out = lookup_join(out.withColumn("_v", F.col(quoted(c))), by_text, ["_v"], "left").drop("_v")
    return out.withColumns({f"edtf_{c}": F.coalesce(F.col(quoted(f"edtf_{c}")), F.lit("")) for c in columns})


def result_cells(images: DataFrame, sep: str = "; ") -> DataFrame:
    """``(record_id, key, value, ord)`` of accepted image results; lists are
    joined, blank values dropped."""
    accepted = images.where((F.col("review_status") == "accepted") & has_text(F.coalesce("record_id", F.lit(""))))
    pairs = accepted.select("record_id", "ord", F.explode(F.from_json("result", "map<string,string>")).alias("key", "raw"))
    items = F.filter(F.from_json("raw", "array<string>"), lambda x: strip(x) != "")
    value = F.when(F.col("raw").startswith("["), F.array_join(items, sep)).otherwise(F.col("raw"))
    return pairs.select("record_id", "key", value.alias("value"), "ord").where(strip(F.col("value")) != "")


def image_columns(df: DataFrame, images: DataFrame, id_column: str, sep: str = "; ") -> DataFrame:
    """``image_<key>`` of accepted results; a later image overwrites a key."""
    cells = result_cells(images, sep)
    keys = sorted(r[0] for r in cells.select("key").distinct().collect())  # the keys of a result schema
    accepted = images.where((F.col("review_status") == "accepted") & has_text(F.coalesce("record_id", F.lit(""))))
    review = accepted.groupBy(F.col("record_id").alias("_rid")).agg(F.max_by(F.struct("review_status", "review_comment", "reviewer"), "ord").alias("_r")).select(
        "_rid", F.col("_r.review_status").alias("image_review_status"), F.col("_r.review_comment").alias("image_review_comment"), F.col("_r.reviewer").alias("image_reviewer")
    )
    wide = cells.groupBy(F.col("record_id").alias("_rid")).pivot("key", keys).agg(F.max_by("value", "ord")).select(
        "_rid", *[F.col(quoted(k)).alias(f"image_{k}") for k in keys]
    )
    new = [f"image_{k}" for k in keys] + ["image_review_status", "image_review_comment", "image_reviewer"]
    out = lookup_join(df.withColumn("_rid", F.col(quoted(id_column)).cast("string")), review.join(wide, "_rid", "left"), ["_rid"], "left").drop("_rid")
    return out.withColumns({c: F.coalesce(F.col(quoted(c)), F.lit("")) for c in new})


def enrich(
    df: DataFrame, mentions: DataFrame | None = None, dates: DataFrame | None = None, images: DataFrame | None = None,
    terms: DataFrame | None = None, id_column: str = "record_id", sep: str = "; ", statuses: list[str] | None = None,
) -> DataFrame:
    """The table with every enrichment that is given, all labels of a record in
    its cells. A record gets the labels without a record only where it has none
    of its own."""
    out = df
    if mentions is not None:
        rows = labels(mentions, statuses)
        joined = ordered_text(rows, ["record_id", "entity_type"], "label", "ord", "text", sep)
        out = _with_global(out, _pivot(joined, "text", ENTITY_COLUMNS), id_column, list(ENTITY_COLUMNS.values()))
    if dates is not None:
        out = edtf_columns(out, dates, id_column)
    if images is not None:
        out = image_columns(out, images, id_column, sep)
    if terms is not None and mentions is not None:
        per_type, per_record = authority_ids(rows, terms, sep)
        names = {code: f"gnd_{column[len('ner_'):]}_ids" for code, column in ENTITY_COLUMNS.items()}
        wide = per_record.join(_pivot(per_type, "ids", names), "record_id", "left")
        out = _with_global(out, wide, id_column, ["gnd_ids", *names.values()])
    return out
