"""Pairs of names that share most of their words, without comparing all pairs.

Two word sets with a Jaccard similarity of ``threshold`` share a word among the
few rarest of each (their prefixes), are about the same size, and share it early enough
to leave room for the rest. A join on the prefix words and the partner's size
finds every such pair; the first common word decides which hit is kept, so that
no pair is made twice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ENTITY_TO_AUTHORITY, mapped
from ..session import cut_lineage
from .authority import authority_names, match_key
from .joins import lookup_join, top_rows

#: Keeps quotients like 0.6 * 5 from rounding over a whole number.
SLACK = 1e-9


def words_of(c: Column) -> Column:
    """The distinct words of a name in lower case, sorted: runs of letters, digits and marks."""
    found = F.split(match_key(c), r"[^\p{L}\p{N}\p{M}]+")
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: w != "")))


def word_sets(names: DataFrame) -> DataFrame:
    """``(words)``: each set of words once, however many names have it."""
    return names.select("words").where(F.size("words") > 0).distinct()


def by_rarity(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Sets with their words ordered from the rarest to the most frequent, and their size."""
    parts = lookup_join(sets.select("words", F.explode("words").alias("word")), counts, "word", "inner")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda p: p["word"])
    return parts.groupBy("words").agg(ordered.alias("rare")).withColumn("size", F.size("rare"))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """One row per word of each set's prefix, with its place: a partner that holds none of these
    words shares too few."""
    length = F.col("size") - F.ceil(F.col("size") * threshold - SLACK) + 1
    return sets.select("words", "rare", "size", F.posexplode(F.slice("rare", F.lit(1), length.cast("int"))).alias("at", "word"))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left_words, right_words, score)``: all pairs of word sets at or above the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    left, right = cut_lineage(word_sets(left)), cut_lineage(word_sets(right))
    counts = cut_lineage(left.union(right).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    here = prefixes(by_rarity(left, counts), threshold).select(F.col("words").alias("left_words"), F.col("rare").alias("left_rare"), F.col("size").alias("m"), F.col("at").alias("i"), "word")
    there = prefixes(by_rarity(right, counts), threshold).select(F.col("words").alias("right_words"), F.col("rare").alias("right_rare"), F.col("size").alias("n"), F.col("at").alias("j"), "word")
    sizes = F.sequence(F.ceil(F.col("m") * threshold - SLACK).cast("int"), F.floor(F.col("m") / threshold + SLACK).cast("int"))
    pairs = lookup_join(here.withColumn("n", F.explode(sizes)), there, ["word", "n"], "inner")
    needed = F.ceil((F.col("m") + F.col("n")) * threshold / (1 + threshold) - SLACK)
    fits = 1 + F.least(F.col("m") - F.col("i") - 1, F.col("n") - F.col("j") - 1) >= needed
    earlier = F.size(F.array_intersect(F.slice("left_rare", F.lit(1), F.col("i")), F.slice("right_rare", F.lit(1), F.col("j"))))
    common = F.size(F.array_intersect("left_rare", "right_rare"))
    scored = pairs.where(fits & (earlier == 0)).withColumn("common", common)
    score = F.col("common") / (F.col("m") + F.col("n") - F.col("common"))
    return scored.withColumn("score", score).where(F.col("score") >= threshold - SLACK).select("left_words", "right_words", "score")


def similar_terms(terms: DataFrame, authority: DataFrame, threshold: float = 0.6, k: int = 5, by_type: bool = True) -> DataFrame:
    """Up to ``k`` authority records per distinct (text, entity_type) whose names, preferred or variant,
    share words with it: best Jaccard similarity first, then the record's order. Exact names
    have similarity 1. Terms and names without a word match nothing.

    With ``by_type`` a record of another type than the term's, or of none, does not count; a
    term whose type stands for none takes all."""
    wanted = terms.select("text", "entity_type").distinct().withColumn("words", words_of(F.col("text")))
    records = authority_names(authority).withColumn("words", words_of(F.col("name")))
    found = cut_lineage(similar_sets(wanted, records, threshold))
    # the best name of a record for a word set, before the set's terms multiply it
    hits = lookup_join(found, records.withColumnRenamed("words", "right_words"), ["right_words"], "inner")
    best = hits.groupBy("left_words", "authority_id").agg(
        F.max("score").alias("score"), F.first("preferred_name").alias("preferred_name"), F.first("authority_type").alias("authority_type"),
        F.first("source").alias("source"), F.min("ord").alias("ord"))
    keys = ["words"]
    wanted = wanted.where(F.size("words") > 0)
    best = best.withColumnRenamed("left_words", "words")
    if by_type:
        wanted = wanted.withColumn("kind", mapped(F.col("entity_type"), ENTITY_TO_AUTHORITY, "*"))
        best = best.withColumn("kind", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce("authority_type", F.lit("*"))))))
        keys = ["words", "kind"]
    order = [F.desc("score"), F.col("ord"), F.col("authority_id")]
    ranked = top_rows(best, keys, order, k, "rank")  # no term can use more of a word set's records
    joined = lookup_join(wanted, ranked, keys, "inner")
    return joined.select("text", "entity_type", "authority_id", "preferred_name", "authority_type", "source", "rank", F.round("score", 4).alias("score"))
