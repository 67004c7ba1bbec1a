"""Text expressions shared by all operators; all of them run inside codegen
except :func:`nfc`, which only touches rows that hold combining marks."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of "no value" in collection exports.
NULL_TOKENS = ["", "nan", "NaN", "NULL", "None", "N/A", "n/a"]

# Every character that counts as blank, so that NBSP and tabs are trimmed too.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def clean_cell(c: Column) -> Column:
    """Strip, then turn null tokens into null. Stripping first makes a blank
    cell count as missing in every later step."""
    s = strip(c)
    return F.when(s.isin(NULL_TOKENS), None).otherwise(s)


def is_missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def edge_blank(c: Column) -> Column:
    return c != strip(c)


def split_values(c: Column, sep: str = ";") -> Column:
    """Split a multi-value cell, trim the parts and drop empty ones."""
    parts = F.transform(F.split(c, F.lit("\\" + sep)), strip)
    return F.filter(parts, lambda p: p != "")


def split_terms(c: Column) -> Column:
    """Terms of a cell; ``;`` wins over ``|`` when both occur."""
    parts = (
        F.when(c.contains(";"), F.split(c, ";"))
        .when(c.contains("|"), F.split(c, "\\|"))
        .otherwise(F.array(c))
    )
    return F.filter(F.transform(parts, strip), lambda t: t != "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def collapse_blanks(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_term(c: Column) -> Column:
    """NFC, collapsed blanks, trimmed. Text below U+0300 is in NFC already, so
    only the rest is handed to Python; other rows cross over as null."""
    hard = c.rlike(r"[^\x00-\u02FF]")
    return collapse_blanks(F.coalesce(nfc(F.when(hard, c)), c))


def parse_confidence(c: Column) -> Column:
    """``"85%"`` and ``"0.85"`` to 0.85; anything unreadable to 0. Text above 1
    without a percent sign is kept as it is."""
    s = strip(c)
    percent = F.regexp_replace(s, "%$", "").try_cast("double") / F.lit(100.0)
    return F.coalesce(F.when(s.endswith("%"), percent).otherwise(s.try_cast("double")), F.lit(0.0))


def number_confidence(c: Column) -> Column:
    """Numeric confidence; values above 1 are percent."""
    d = c.cast("double")
    return F.coalesce(F.when(d > 1.0, d / F.lit(100.0)).otherwise(d), F.lit(0.0))


def strip_code_fence(c: Column) -> Column:
    """Drop BOM, blanks and a Markdown code fence around a JSON answer."""
    body = F.regexp_replace(strip(c), r"^﻿+", "")
    opened = F.when(body.startswith("```"), F.regexp_replace(body, r"^```[^\n]*(\n|$)", "")).otherwise(body)
    closed = F.when(
        body.startswith("```") & opened.endswith("```"), F.regexp_replace(opened, r"\s*```$", "")
    ).otherwise(opened)
    return strip(closed)


def parse_json(c: Column) -> Column:
    """Variant of an answer that is a JSON object or array, else null."""
    body = strip_code_fence(c)
    return F.when(body.rlike(r"^[\[{]"), F.try_parse_json(body))


def truncate(c: Column, max_len: int = 100, ellipsis: str = "…") -> Column:
    cut = F.concat(F.substring(c, 1, max_len - len(ellipsis)), F.lit(ellipsis))
    return F.when(F.length(c) > max_len, cut).otherwise(c)


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    """Text to whole number, fractions cut off."""
    return F.coalesce(strip(c).try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\-]", "_")


def base_name(c: Column) -> Column:
    """Last path part, either slash, case ignored."""
    return F.lower(strip(F.regexp_extract(c, r"[^/\\]*$", 0)))


def xml_escape(c: Column) -> Column:
    out = c
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def regex_quote(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\$1")


def utc_timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def fingerprint(default_prompt: Column, override: Column) -> Column:
    """Which prompt text was sent: hash, length, preview, override flag."""
    used = F.when(strip(F.coalesce(override, F.lit(""))) != "", override).otherwise(default_prompt)
    return F.struct(
        F.sha2(used, 256).alias("sha256"),
        F.length(used).alias("length"),
        F.concat(F.substring(used, 1, 240), F.when(F.length(used) > 240, "…").otherwise("")).alias("preview"),
        (strip(F.coalesce(override, F.lit(""))) != "").alias("is_override"),
    )
