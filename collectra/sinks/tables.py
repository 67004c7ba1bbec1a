"""Table-shaped exports: dictionary, review state, terms, report tables."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_csv

# FIXED VALUES: columns of the exported term tables, with ours.
TERM_MATCH = {"term": "term", "cell_value": "value", "column": "column", "record_id": "record_id", "replacement": "replacement", "category": "category", "note": "note"}
TERM_LIST = ["term", "replacement", "category", "note"]


def write_dictionary(entries: DataFrame, path: str, entity_type: str = "") -> None:
    """JSON per dictionary type; one type only when asked for."""
    rows = entries.where(F.col("entity_type") == entity_type) if entity_type else entries
    typed = rows.withColumn("entity_type", F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("other")))
    typed.write.mode("overwrite").partitionBy("entity_type").json(path)


def write_review(frames: dict[str, DataFrame], path: str) -> None:
    """Queue, packages, suggestions and change log, one JSON table each."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(os.path.join(path, name))


def write_mentions_csv(mentions: DataFrame, path: str) -> None:
    write_csv(mentions, path, quote_all=True)


def write_term_matches_csv(matches: DataFrame, path: str) -> None:
    """The result of a term scan, all fields quoted."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in TERM_MATCH.items()]
    write_csv(matches.select(*columns), path, quote_all=True)


def write_term_list_csv(terms: DataFrame, path: str) -> None:
    """A term list in its order, all fields quoted; :func:`collectra.sources.terms` reads it back."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in TERM_LIST]
    write_csv(terms.orderBy("ord").select(*columns) if "ord" in terms.columns else terms.select(*columns), path, quote_all=True)


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(os.path.join(path, name))
