"""Scan cells for problem terms: by expression, by automaton, or by equi-joins on tokens or character grams."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, regex_quote, strip
from ..session import cut_lineage
from .joins import lookup_join

try:
    import ahocorasick
except ImportError:  # then substrings are found by their grams
    ahocorasick = None

# FIXED VALUES: characters that end a word, besides blanks.
BOUNDARY = r"\s,;.!?\"'()\[\]"
SPLIT = rf"(?U)[{BOUNDARY}]+"


def tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, SPLIT)), lambda t: t != "")


def keyed_terms(terms: DataFrame, case_sensitive: bool) -> DataFrame:
    """One row per comparison key; a later entry replaces an earlier one."""
    term = strip(F.col("term"))
    rows = terms.where(has_text(term)).withColumn("key", term if case_sensitive else F.lower(term))
    entry = F.struct("term", "replacement", "category", "note")
    return rows.groupBy("key").agg(F.max_by(entry, "ord").alias("e")).select("key", "e.*")


def _grams(c: Column, n: int) -> Column:
    chars = F.split(c, "")
    last = F.size(chars) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), "")))


#: Terms of one automaton, with what a key takes besides its text.
CHUNK_BYTES, KEY_BYTES = 8 << 20, 48
# Lists up to these sizes are searched inside the projection, without any join.
MAX_INLINE_TERMS = 500
MAX_INLINE_WORDS = 32


def _inline_scan(cells: DataFrame, terms: list, whole_word: bool, out_columns: list[str]) -> DataFrame:
    """Search for a short list of terms in one array expression. A word is
    looked for as plain text first, and its edges are checked only where it is."""
    text = F.col("_text")

    def hit(key: str) -> Column:
        found = F.contains(text, F.lit(key))
        quoted = re.sub(r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\\1", key)
        return found & text.rlike(rf"(?U)(?<![^{BOUNDARY}]){quoted}(?![^{BOUNDARY}])") if whole_word else found

    fields = ["term", "replacement", "category", "note"]
    entries = [F.when(hit(t["key"]), F.struct(*[F.lit(t[f]).alias(f) for f in fields])) for t in terms]
    hits = F.filter(F.array(*entries), lambda t: t.isNotNull())
    return cells.select("record_id", "column", "value", F.explode(hits).alias("t")).select("record_id", "column", "value", "t.*").select(*out_columns)


#: The characters of ``BOUNDARY``; what ``\\s`` stands for are the white space characters of Unicode.
EDGES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))) + ",;.!?\"'()[]")


def _list_bytes(known: DataFrame) -> int:
    return known.agg(F.sum(F.octet_length("key") + KEY_BYTES)).first()[0] or 0


def _automaton_scan(cells: DataFrame, listed: DataFrame, whole_word: bool, out_columns: list[str]) -> DataFrame:
    """Search for a long list of terms with one automaton, which reads each cell once whatever
    the number of terms; a whole word is a place with an edge on both sides. The list is cut by
    hash into chunks of about ``CHUNK_BYTES``; a chunk is what goes to a task, and each is a
    scan of its own. A cell comes back once, with the keys found in it."""
    chunks = max(1, ceil(_list_bytes(listed) / CHUNK_BYTES))
    slim = cells.select("record_id", "column", "value", "_text")
    schema = slim.drop("_text").withColumn("keys", F.array(F.lit(""))).schema

    def scan(keys: list[str]):
        edges = EDGES if whole_word else None

        def found(automaton, text: str) -> list[str]:
            if edges is None:
                return [keys[i] for i in {i for _, i in automaton.iter(text)}]
            hits, last = set(), len(text) - 1
            for end, i in automaton.iter(text):
                start = end - len(keys[i])
                if i not in hits and (start < 0 or text[start] in edges) and (end == last or text[end + 1] in edges):
                    hits.add(i)
            return [keys[i] for i in hits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, key in enumerate(keys):
                automaton.add_word(key, i)
            automaton.make_automaton()
            for batch in batches:
                hits = [found(automaton, text.as_py()) for text in batch.column("_text")]
                rows = batch.select(["record_id", "column", "value"]).columns
                out = pa.RecordBatch.from_arrays([*rows, pa.array(hits, pa.list_(pa.string()))], schema.names)
                yield out.filter(pa.array([bool(h) for h in hits], pa.bool_()))

        return slim.mapInArrow(run, schema)

    frames = []
    for number in range(chunks):
        keys = [r[0] for r in listed.where(F.pmod(F.xxhash64("key"), F.lit(chunks)) == number).select("key").collect()]
        if keys:
            frames.append(scan(keys))
    if not frames:
        return cells.select("record_id", "column", "value", *[F.lit("").alias(c) for c in out_columns[3:]]).limit(0)
    hits = reduce(DataFrame.unionByName, frames).select("record_id", "column", "value", F.explode("keys").alias("key"))
    return lookup_join(hits, listed, ["key"], "inner").select(*out_columns)


def scan_terms(cells: DataFrame, terms: DataFrame, case_sensitive: bool = False, whole_word: bool = True, inline: int | None = None) -> DataFrame:
    """``(record_id, column, value, term, replacement, category, note)`` for
    every cell and term that occurs in it.

    A list of up to ``inline`` terms (by default 32 words or 500 substrings) is one
    expression per cell. Beyond that, whole words: any match contains the first token of the term as a token of
    the cell, so cells are exploded to distinct tokens and joined on it; terms
    of several tokens are then checked against the cell. Substrings of a long
    term list, and terms made of boundary characters only, are joined on their
    leading one to three characters instead and checked the same way. No cell
    is joined to a term it does not share an anchor with. The exploded rows hold a
    hash of the cell and one anchor; the text joins again where a term was found.
    Where pyahocorasick is installed, long lists of substrings, and of whole words up to ``CHUNK_BYTES``,
    are searched with an automaton instead, so that a cell is neither exploded nor shuffled.
    """
    known = keyed_terms(terms, case_sensitive)
    cells = cells.where(has_text(F.col("value"))).withColumn(
        "_text", F.col("value") if case_sensitive else F.lower("value")
    )
    inside = F.concat(
        F.lit(rf"(?U)(?<![^{BOUNDARY}])"), regex_quote(F.col("key")), F.lit(rf"(?![^{BOUNDARY}])")
    )
    first = F.get(F.filter(F.split(F.col("key"), SPLIT), lambda t: t != ""), F.lit(0))
    out_columns = ["record_id", "column", "value", "term", "replacement", "category", "note"]
    bound = inline if inline is not None else MAX_INLINE_WORDS if whole_word else MAX_INLINE_TERMS
    short = known.limit(bound + 1).collect()
    if 0 < len(short) <= bound:
        return _inline_scan(cells, short, whole_word, out_columns)
    if ahocorasick is not None:
        listed = cut_lineage(known.select("key", *out_columns[3:]))
        if not whole_word or _list_bytes(listed) <= CHUNK_BYTES:
            return _automaton_scan(cells, listed, whole_word, out_columns)
    known = known.withColumn("_anchor", first if whole_word else F.lit(None).cast("string"))
    by_token = known.where(F.col("_anchor").isNotNull())
    by_gram = known.where(F.col("_anchor").isNull()).withColumn("_n", F.least(F.lit(3), F.length("key")))
    frames = []
    cells = cells.withColumn("_cell", F.xxhash64("record_id", "column", "value"))

    def found(anchors: Column, listed: DataFrame, check: Column) -> DataFrame:
        slim = cells.select("_cell", F.explode(anchors).alias("_anchor"))
        pairs = lookup_join(slim, listed, ["_anchor"], "inner").select("_cell", "_anchor", "key", *out_columns[3:]).distinct()
        return lookup_join(cells, pairs, ["_cell"], "inner").where(F.contains("_text", F.col("key")) & check).select(*out_columns)

    if whole_word:
        frames.append(found(tokens(F.col("_text")), by_token, (F.col("key") == F.col("_anchor")) | F.regexp_like("_text", inside)))
    for row in by_gram.select("_n").distinct().collect():  # at most three lengths
        n = row[0]
        anchored = by_gram.where(F.col("_n") == n).withColumn("_anchor", F.substring("key", 1, n))
        frames.append(found(_grams(F.col("_text"), n), anchored, F.regexp_like("_text", inside) if whole_word else F.lit(True)))
    if not frames:
        return cells.select("record_id", "column", "value", *[F.lit("").alias(c) for c in out_columns[3:]]).limit(0)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ocr_cells(images: DataFrame) -> DataFrame:
    """Transcribed text of images as cells."""
    text = F.coalesce(
        F.nullif(F.get_json_object("result", "$.transcription"), F.lit("")), F.get_json_object("result", "$.text")
    )
    return images.select(
        F.coalesce(F.nullif("record_id", F.lit("")), "image_id").alias("record_id"),
        F.concat(F.lit("[OCR] "), "filename").alias("column"), text.alias("value"),
    ).where(has_text(F.col("value")))


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("term", "category").agg(F.count("*").alias("matches"))


def add_new_terms(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing terms, then new ones whose lower-case form is not known yet;
    within the new ones the first spelling wins."""
    firsts = (
        new.where(has_text(strip(F.col("term")))).withColumn("term", strip(F.col("term")))
        .groupBy(F.lower("term").alias("_key"))
        .agg(F.min_by(F.struct(*new.columns), "ord").alias("e"))
    )
    known = existing.select(F.lower("term").alias("_key")).distinct()
    return existing.unionByName(lookup_join(firsts, known, ["_key"], "left_anti").select("e.*"), allowMissingColumns=True)
