"""CSV and TSV exports as tables of clean text."""
from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell
from ..operators.profile import Dataset, column_profile, detect_id_column, id_candidates, quoted, value_counts
from .files import SPARK_NAMES, file_facts, preview
from .records import block_states, read_records

# Encodings in which line feeds, quotes and delimiters are the bytes of ASCII.
BYTE_WISE = ("utf-8", "cp1252", "latin-1")
SUFFIXES = (".csv", ".tsv", ".txt")
# cp1252 is Latin-1 but for one block of control characters.
_CP1252 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_CP1252 = {k: v for k, v in _CP1252.items() if v}


def from_latin1(df: DataFrame) -> DataFrame:
    """cp1252 text that was read as Latin-1, which Spark can decode natively."""
    old, new = F.lit("".join(_CP1252)), F.lit("".join(_CP1252.values()))
    return df.select(*[F.call_function("translate", F.col(quoted(c)), old, new).alias(c) for c in df.columns])


def clean_table(df: DataFrame) -> DataFrame:
    """Strip every cell, then turn null tokens into null, in one projection."""
    return df.select(*[clean_cell(F.col(quoted(c)).cast("string")).alias(c.lstrip("﻿")) for c in df.columns])


def load_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, facts: list[dict] | None = None) -> DataFrame:
    """A file or folder of CSV files as one table of text columns.

    Files are grouped by encoding, delimiter and header line, so that a group
    has one column order; each group is one scan, and groups are united by
    column name. Encodings are decided file by file. Nothing but names is inferred.

    One pass over the lines finds bytes that are not UTF-8 and line breaks inside quotes.
    Groups without such breaks are read line by line, the others as records put together
    from the lines of each block; a file is read by many tasks either way. Only
    UTF-16 and files whose first block has no line feed are read whole.
    """
    facts = facts or file_facts(spark, path, SUFFIXES)
    if not facts:
        raise FileNotFoundError(f"no CSV, TSV or TXT files in {path}")
    byte_wise = {f["path"]: delimiter or f["delimiter"] for f in facts if (encoding or f["encoding"]) in BYTE_WISE and f["line_ending"]}
    intervals, breaks, broken = block_states(spark, byte_wise) if byte_wise else ({}, set(), set())
    groups: dict[tuple[str, str, str], list[str]] = {}
    for f in facts:
        enc = encoding or ("cp1252" if f["encoding"] == "utf-8" and f["path"] in broken else f["encoding"])
        header = f["header"] if f.get("header") is not None else f["path"]  # a header too long to compare stands alone
        groups.setdefault((enc, delimiter or f["delimiter"], header), []).append(f["path"])
    frames = []
    for (enc, sep, _), files in sorted(groups.items()):
        charset = SPARK_NAMES.get(enc, enc)
        options = {"header": True, "sep": sep, "encoding": charset, "escape": '"', "quote": '"'}
        whole = not all(f in byte_wise for f in files)
        if whole or not breaks.intersection(files):
            raw = spark.read.options(multiLine=whole, **options).csv(files)
        else:
            names = spark.read.options(multiLine=True, **options).csv(files[0]).columns  # reads up to the first record
            raw = read_records(spark, {f["path"]: f.get("crlf", False) for f in facts if f["path"] in files}, sep, names, charset, intervals)
        frames.append(clean_table(from_latin1(raw) if enc == "cp1252" else raw))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ingest_csv(spark: SparkSession, path: str) -> tuple[Dataset, DataFrame]:
    """(data set with file facts and id column, its column profile)."""
    facts = file_facts(spark, path, SUFFIXES)
    df = load_csv(spark, path, facts=facts)
    return describe(df, os.path.splitext(os.path.basename(path.rstrip("/")))[0], facts)


def describe(df: DataFrame, name: str, facts: list[dict] | None = None) -> tuple[Dataset, DataFrame]:
    profile = column_profile(value_counts(df)).withColumn("dataset", F.lit(name))
    first = facts[0] if facts else {"encoding": "utf-8", "has_bom": False, "line_ending": ""}
    found = Dataset(
        name, df, detect_id_column(profile, df.columns), has_bom=any(f["has_bom"] for f in facts or []),
        line_ending=first["line_ending"], encoding=first["encoding"],
    )
    return found, profile


def preview_csv(spark: SparkSession, path: str, rows: int = 10, sample: int = 1000, max_columns: int = 2000) -> dict:
    """What an import would see: facts, columns, first rows, likely id columns
    of the first ``sample`` rows, warnings."""
    facts, top = preview(spark, path, sample)
    table = clean_table(top)
    ids = id_candidates(column_profile(value_counts(table)), table.columns)
    warnings = [w for w in [facts["warning"], "too many columns" if len(table.columns) > max_columns else ""] if w]
    return {**facts, "head": table.limit(rows), "id_candidates": ids, "warnings": warnings}
