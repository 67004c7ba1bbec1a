"""Authority dictionary as three tables.

``entries`` has one row per term (key = lower case), ``spellings`` one row per
further spelling, ``links`` one row per term and record. A term that occurs in
a third of all records is many rows of ``links``, never one huge array.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import DICTIONARY_TO_CODE, ENTITY_TO_DICTIONARY, authority_label, mapped
from ..functions.text import has_text, split_values
from .joins import best_row, lookup_join
from .profile import quoted


@dataclass
class Dictionary:
    entries: DataFrame
    spellings: DataFrame
    links: DataFrame


def dictionary_type(c: Column) -> Column:
    """Entity codes become dictionary types, anything else stays."""
    return F.when(c.isin([k for k in ENTITY_TO_DICTIONARY if k != "TOP"]), mapped(c, ENTITY_TO_DICTIONARY)).otherwise(c)


def term_rows(df: DataFrame, columns: list[str], id_column: str, entity_type: str = "", source: str = "ingest") -> DataFrame:
    """``(term, record_id, entity_type, source, ord)``: one row per value in
    the listed columns, ordered by record, column and position."""
    frames = []
    for i, c in enumerate(columns):
        frames.append(
            df.select(F.col(quoted(id_column)).cast("string").alias("record_id"), F.posexplode(split_values(F.col(quoted(c)))).alias("pos", "term"))
            .select("term", "record_id", F.lit(entity_type).alias("entity_type"), F.lit(source).alias("source"),
                    F.struct(F.col("record_id").alias("r"), F.lit(i).alias("c"), F.col("pos").alias("p")).alias("ord"))
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(~F.col("term").isin("nan", "NaN"))


def build(rows: DataFrame) -> Dictionary:
    """Group term rows by lower case; every aggregate combines map-side."""
    rows = rows.where(has_text(F.col("term"))).withColumn("key", F.lower("term"))
    first = F.struct("term", "source")
    typed = F.when(F.coalesce(F.col("entity_type"), F.lit("")) != "", F.col("ord"))
    entries = rows.groupBy("key").agg(
        F.min_by(first, F.col("ord")).alias("f"), F.min_by("entity_type", typed).alias("entity_type"), F.count("*").alias("occurrences")
    ).select("key", "f.term", F.coalesce(dictionary_type(F.col("entity_type")), F.lit("")).alias("entity_type"), "f.source", "occurrences")
    spelled = rows.groupBy("key", "term").agg(F.count("*").alias("n"))
    spellings = spelled.join(entries.select("key", F.col("term").alias("_main")), "key").where("term <> _main").select(
        "key", F.col("term").alias("spelling"), "n"
    )
    links = rows.where(has_text(F.col("record_id"))).select("key", "record_id").distinct()
    return Dictionary(entries, spellings, links)


def merge(old: Dictionary, new: Dictionary) -> Dictionary:
    """Existing entries stay, get a type if they had none, and gain spellings
    and records; unknown terms are added."""
    add = new.entries.select("key", F.struct(*new.entries.columns).alias("n"))
    both = old.entries.select("key", F.struct(*old.entries.columns).alias("o")).join(add, "key", "full_outer")
    typed = F.coalesce(F.nullif(F.col("o.entity_type"), F.lit("")), F.col("n.entity_type"), F.lit(""))
    entries = both.select(
        "key", F.coalesce("o.term", "n.term").alias("term"), typed.alias("entity_type"), F.coalesce("o.source", "n.source").alias("source"),
        (F.coalesce("o.occurrences", F.lit(0)) + F.coalesce("n.occurrences", F.lit(0))).alias("occurrences"),
    )
    seen = (
        old.spellings.select("key", "spelling", "n").unionByName(new.spellings.select("key", "spelling", "n"))
        .unionByName(new.entries.select("key", F.col("term").alias("spelling"), F.col("occurrences").alias("n")))
        .groupBy("key", "spelling").agg(F.sum("n").alias("n"))
    )
    spellings = seen.join(entries.select("key", "term"), "key").where("spelling <> term").drop("term")
    return Dictionary(entries, spellings, old.links.unionByName(new.links).distinct())


def from_mentions(mentions: DataFrame, status: str = "accepted", types: list[str] | None = None, source: str = "ner") -> Dictionary:
    """Accepted mentions as dictionary terms."""
    chosen = mentions.where(F.col("status") == status) if status else mentions
    if types:
        chosen = chosen.where(F.col("entity_type").isin(types))
    return build(chosen.select(
        F.col("text").alias("term"), "record_id", mapped(F.col("entity_type"), ENTITY_TO_DICTIONARY, "other").alias("entity_type"),
        F.lit(source).alias("source"), "ord",
    ))


def from_matches(matches: DataFrame) -> DataFrame:
    """Best authority match per preferred name, first one on a tie."""
    keyed = matches.withColumn("key", F.coalesce(F.nullif(F.lower("preferred_name"), F.lit("")), F.lower("term")))
    best = best_row(keyed, ["key"], [F.col("confidence").desc(), F.col("ord"), F.col("slot")])
    return best.select("key", F.coalesce(F.nullif("preferred_name", F.lit("")), "term").alias("term"), "authority_id", "authority_type", "confidence")


def names(entries: DataFrame, spellings: DataFrame) -> DataFrame:
    """Every name of the dictionary with the entry it leads to: the entry that
    comes first (``ord``), by its term or any of its spellings."""
    own = entries.select(F.lower("term").alias("name"), "key", "ord")
    other = spellings.join(entries.select("key", "ord"), "key").select(F.lower("spelling").alias("name"), "key", "ord")
    return own.unionByName(other).groupBy("name").agg(F.min_by("key", F.struct("ord", "key")).alias("key"))


def lookup(texts: DataFrame, text: str, entries: DataFrame, spellings: DataFrame) -> DataFrame:
    """Add the ``key`` of the dictionary entry for a text, null if none."""
    found = names(entries, spellings).withColumnRenamed("name", "_name")
    return lookup_join(texts.withColumn("_name", F.lower(text)), found, ["_name"], "left").drop("_name")


def lookup_id(texts: DataFrame, column: str, entries: DataFrame, id_column: str = "gnd_id") -> DataFrame:
    """Add the ``key`` of the first entry (by ``ord``) that has the id of a row in ``column``: an authority id
    such as ``gnd_id``, or an ``entry_id``. Empty ids lead nowhere."""
    named = entries.where(has_text(F.col(id_column))).groupBy(F.col(id_column).alias(column)).agg(F.min_by("key", F.struct("ord", "key")).alias("key"))
    return lookup_join(texts, named, [column], "left")


def target_format(entries: DataFrame, spellings: DataFrame, links: DataFrame) -> DataFrame:
    """Hand-over rows: first record, type code, normalised term, authority."""
    first = links.groupBy("key").agg(F.min("record_id").alias("record_id"))
    others = spellings.groupBy("key").agg(F.count("*").alias("variant_count"))

    def col(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in entries.columns else F.lit("")

    kind = F.lower(col("entity_type"))
    named = F.coalesce(F.nullif(col("term_normalized"), F.lit("")), F.nullif(col("preferred_name"), F.lit("")), F.col("term"))
    return entries.join(first, "key", "left").join(others, "key", "left").select(
        "key", F.coalesce("record_id", F.lit("")).alias("record_id"), mapped(kind, DICTIONARY_TO_CODE, F.upper(kind)).alias("entity_type"),
        named.alias("term_normalized"), F.coalesce("variant_count", F.lit(0)).alias("variant_count"),
        F.coalesce(F.nullif(col("gnd_preferred"), F.lit("")), col("preferred_name")).alias("authority"),
        authority_label(col("gnd_id"), col("wikidata_id"), col("geonames_id")).alias("authority_id"), F.col("source"),
    )


def type_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("other")).alias("entity_type")).agg(F.count("*").alias("n"))


def apply_changes(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Merge a change table (``op`` add, update or delete, ``ord``) by key.

    The changes of a key take effect in the order of ``ord``. Updates overwrite the
    columns they fill, deletes drop the row, adds need a key that is not there at that
    moment. Returns the merged table and the refused changes, ``(key, op)``.

    After an add the row is there and after a delete it is not, refused or not, so
    the nearest add or delete before a change tells whether it finds its row.
    """
    columns = [c for c in table.columns if c != key]
    known = table.select(key).withColumn("_known", F.lit(True))
    op, whole = F.col("op"), Window.partitionBy(key)
    before = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    there = F.when(op == "add", True).when(op == "delete", False)
    steps = changes.join(known, key, "left").withColumn(
        "_there", F.coalesce(F.last(there, ignorenulls=True).over(before), F.col("_known"), F.lit(False))
    ).withColumn("_refused", (op == "add") == F.col("_there")).withColumn("_dropped", F.max(F.when(op == "delete", F.col("ord"))).over(whole))
    alive = ~F.col("_refused") & (op != "delete") & F.coalesce(F.col("ord") > F.col("_dropped"), F.lit(True))
    news = [
        (F.max(F.when(alive & F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))["v"] if c in changes.columns else F.lit(None)).cast(
            table.schema[c].dataType)
        for c in columns
    ]
    delta = steps.groupBy(key).agg(
        F.max("_dropped").isNotNull().alias("_gone"), F.coalesce(F.bool_or(alive & (op == "add")), F.lit(False)).alias("_new"),
        *[n.alias(f"_new_{c}") for n, c in zip(news, columns, strict=True)])
    both = table.withColumn("_old", F.lit(True)).join(delta, key, "full_outer")
    old = F.coalesce(F.col("_old"), F.lit(False)) & ~F.coalesce(F.col("_gone"), F.lit(False))
    merged = both.where(old | F.coalesce(F.col("_new"), F.lit(False))).select(
        key, *[F.coalesce(F.col(f"_new_{c}"), F.when(old, F.col(c))).alias(c) for c in columns])
    return merged, steps.where("_refused").select(key, "op")
