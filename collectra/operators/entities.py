"""Extracted mentions: dedupe, merge, storage rules and dictionary lookup."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ENTITY_LABELS, TAGGER_TO_ENTITY, mapped
from ..functions.text import strip
from .joins import best_row
from .terms import scan_terms


def mention_key() -> Column:
    """Text without edge blanks and case, with the type."""
    return F.concat_ws("||", F.lower(strip(F.col("text"))), F.col("entity_type"))


def entity_code(label: Column) -> Column:
    """Tagger label to entity code; a known code stays, anything else is a concept."""
    return F.when(label.isin(list(ENTITY_LABELS)), label).otherwise(mapped(label, TAGGER_TO_ENTITY, "CON"))


def _confident() -> list[Column]:
    return [F.col("confidence").desc(), F.col("ord")]


def unique_mentions(mentions: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Most confident mention of each text and type, first one on a tie."""
    keyed = mentions.withColumn("_key", mention_key())
    return best_row(keyed, [*(within or []), "_key"], _confident()).drop("_key")


def merge_extractions(rules: DataFrame, model: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Union of two extractions. A mention both found is ``hybrid`` and keeps
    the more confident side, the model on a tie; the rest keep their source.
    With ``by`` the exact columns are the key, else text and type are."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        key = F.concat_ws("||", *by) if by else mention_key()
        best = best_row(df.withColumn("_key", key), ["_key"], _confident())
        return best.select("_key", F.struct(*df.columns).alias(prefix))

    both = side(rules, "a").join(side(model, "b"), "_key", "full_outer")  # keys are distinct on both sides
    a, b = F.col("a"), F.col("b")
    winner = F.when(b.isNull(), a).when(a.isNull(), b).when(F.col("b.confidence") >= F.col("a.confidence"), b).otherwise(a)
    merged = both.select(winner.alias("w"), (a.isNotNull() & b.isNotNull()).alias("_both"))
    return merged.select("w.*", "_both").withColumn("source", F.when(F.col("_both"), "hybrid").otherwise(F.col("source"))).drop("_both")


def of_types(mentions: DataFrame, types: list[str] | None) -> DataFrame:
    return mentions.where(F.col("entity_type").isin(types)) if types else mentions


def type_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_type").agg(F.count("*").alias("n")).withColumn(
        "label", mapped(F.col("entity_type"), ENTITY_LABELS)
    )


def add_mentions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Stored mentions plus new ones. The same text, type and record is stored
    once, with its first values but the highest confidence and that one's source."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = existing.columns
    first = F.min_by(F.struct(*columns), F.struct("_new", "ord"))
    best = F.max_by(F.struct("confidence", "source"), F.struct(F.col("confidence"), -F.col("_new"), -F.col("ord")))
    grouped = both.groupBy(F.lower("text").alias("_t"), F.col("entity_type").alias("_e"), F.col("record_id").alias("_r")).agg(
        first.alias("f"), best.alias("b")
    )
    return grouped.select(*[
        F.col(f"b.{c}").alias(c) if c in ("confidence", "source") else F.col(f"f.{c}").alias(c) for c in columns
    ])


def gazetteer_mentions(cells: DataFrame, dictionary: DataFrame, confidence: float = 0.6) -> DataFrame:
    """Mentions of dictionary terms in cells, found by the token join of the
    term scan. ``dictionary`` has term, entity_type and ord."""
    known = dictionary.select(
        "term", F.lit("").alias("replacement"), F.col("entity_type").alias("category"), F.lit("").alias("note"), "ord"
    )
    return scan_terms(cells, known).select(
        "record_id", F.col("column").alias("source_column"), F.col("term").alias("text"), F.col("category").alias("entity_type"),
        F.lit(confidence).alias("confidence"), F.lit("gazetteer").alias("source"),
    )


def auto_accept(items: DataFrame, status: str, min_confidence: float, types: list[str] | None = None, only: Column | None = None) -> DataFrame:
    """Accept pending items that are confident enough, with a note why."""
    hit = (F.col(status) == "pending") & (F.col("confidence") >= min_confidence)
    if types:
        hit = hit & F.col("entity_type").isin(types)
    if only is not None:
        hit = hit & only
    note = F.concat(F.lit("Auto-accepted (confidence "), F.format_string("%.2f", "confidence"), F.lit(f" >= {min_confidence})"))
    old_note = F.col("reviewer_note") if "reviewer_note" in items.columns else F.lit("")
    return items.withColumns({
        status: F.when(hit, "accepted").otherwise(F.col(status)), "reviewer_note": F.when(hit, note).otherwise(old_note)
    })


def link_matches(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    """Carry the top authority match of a text and type back to its mentions."""
    from .joins import lookup_join

    new = matches.select("text", "entity_type", F.col("authority_id").alias("_id"), F.col("preferred_name").alias("_name"))
    return lookup_join(mentions, new, ["text", "entity_type"], "left").withColumns({
        "gnd_id": F.coalesce("_id", "gnd_id"), "gnd_preferred": F.coalesce("_name", "gnd_preferred")
    }).drop("_id", "_name")
