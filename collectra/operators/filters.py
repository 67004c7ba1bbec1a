"""Row selection: rule filters, facets, pages, status filters and gates."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from .joins import lookup_join
from .profile import quoted

MAX_INLINE_IDS = 1000


def apply_rules(df: DataFrame, rules: list[dict], id_column: str | None = None, record_ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Keep listed records that meet every rule. ``contains`` is a
    case-insensitive regular expression; null never matches; rules on unknown
    columns are ignored. Ids come as a frame or a list; a long list is joined."""
    if record_ids is not None and id_column in df.columns:
        if isinstance(record_ids, DataFrame):
            ids = record_ids.select(F.col(record_ids.columns[0]).cast("string").alias(id_column)).distinct()
            df = lookup_join(df, ids, [id_column], "left_semi")
        else:
            listed = [str(v) for v in record_ids if str(v).strip()]
            if len(listed) > MAX_INLINE_IDS:
                ids = df.sparkSession.createDataFrame([(v,) for v in listed], f"`{id_column}` string").distinct()
                df = lookup_join(df, ids, [id_column], "left_semi")
            else:
                df = df.where(F.col(quoted(id_column)).cast("string").isin(listed))
    for rule in rules:
        if rule.get("column") not in df.columns:
            continue
        cell, value = F.col(quoted(rule["column"])).cast("string"), str(rule.get("value", ""))
        op = (rule.get("op") or "contains").lower()
        if op == "equals":
            test = cell == value
        elif op == "startswith":
            test = cell.startswith(value)
        else:
            test = cell.rlike("(?iu)" + value)
        df = df.where(F.coalesce(test, F.lit(False)))
    return df


def _contains(c: Column, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(text.lower())), F.lit(False))


def facet_tests(df: DataFrame, search: str = "", selected: dict[str, list[str]] | None = None, texts: dict[str, str] | None = None) -> tuple[Column, dict[str, Column]]:
    """(global test, test per column) of a faceted view."""
    whole = reduce(lambda a, b: a | b, [_contains(F.col(quoted(c)), search) for c in df.columns]) if search else F.lit(True)
    tests: dict[str, Column] = {}
    for column, values in (selected or {}).items():
        if values:
            tests[column] = F.coalesce(F.col(quoted(column)).isin(values), F.lit(False))
    for column, text in (texts or {}).items():
        if text:
            test = _contains(F.col(quoted(column)), text)
            tests[column] = tests[column] & test if column in tests else test
    return whole, tests


def faceted_rows(df: DataFrame, **view) -> DataFrame:
    """Rows that match the search and the filter of every column."""
    whole, tests = facet_tests(df, **view)
    return df.where(reduce(lambda a, b: a & b, tests.values(), whole))


def facet_counts(df: DataFrame, columns: list[str], **view) -> DataFrame:
    """Value counts per facet column; each column ignores its own filter.

    One scan for all columns: a row counts for column ``c`` when no other
    column fails. ``total`` is the count without any filter.
    """
    whole, tests = facet_tests(df, **view)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value"),
            reduce(lambda a, b: a & b, [t for k, t in tests.items() if k != c], whole).alias("hit"),
        )
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("f")).select("f.*").where(has_text(F.col("value")))
        .groupBy("column", "value").agg(F.count_if("hit").alias("n"), F.count("*").alias("total"))
    )


def sorted_facets(counts: DataFrame) -> DataFrame:
    return counts.orderBy("column", F.col("total").desc(), "value")


def id_page(df: DataFrame, id_column: str, search: str = "", offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of distinct ids in ascending order, with ``has_more`` telling
    whether more follow: one row beyond the page is read for it."""
    limit = max(1, limit)
    ids = df.select(F.col(quoted(id_column)).cast("string").alias("record_id")).where("record_id IS NOT NULL").distinct()
    if search:
        ids = ids.where(_contains(F.col("record_id"), search))
    page = ids.orderBy("record_id").offset(max(offset, 0)).limit(limit + 1)
    rank = Window.orderBy("record_id")  # over limit + 1 rows
    return page.select("record_id", F.row_number().over(rank).alias("_n"), (F.count("*").over(Window.partitionBy()) > limit).alias("has_more")).where(
        F.col("_n") <= limit).drop("_n")


def id_total(df: DataFrame, id_column: str, search: str = "") -> DataFrame:
    ids = df.select(F.col(quoted(id_column)).cast("string").alias("record_id")).where("record_id IS NOT NULL").distinct()
    if search:
        ids = ids.where(_contains(F.col("record_id"), search))
    return ids.agg(F.count("*").alias("total"))


def item_page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def queue_filter(
    items: DataFrame, severity=None, column=None, category=None, status=None, min_confidence=None, max_confidence=None,
    source=None, is_ai_based=None,
) -> DataFrame:
    """Review items that meet all given filters; items without a confidence
    fail a confidence bound."""
    equal = {"severity": severity, "column": column, "category": category, "status": status, "source": source, "is_ai_based": is_ai_based}
    for name, value in equal.items():
        if value is not None:
            items = items.where(F.col(name) == value)
    if min_confidence is not None:
        items = items.where(F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        items = items.where(F.col("confidence") <= max_confidence)
    return items


def by_values(df: DataFrame, **wanted) -> DataFrame:
    """Equality filter on any columns; empty values do not filter."""
    for name, value in wanted.items():
        if value in (None, "", []):
            continue
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def active_mappings(mappings: DataFrame) -> DataFrame:
    """Enabled mappings that are not ignored, in order."""
    return mappings.where(F.col("enabled") & (F.col("target_type") != "__ignore__")).orderBy("ord")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without a changed key, then the changes."""
    return lookup_join(existing, changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def has_pending(images: DataFrame) -> bool:
    """Gate: does any image result still wait for review? Stops at the first."""
    return not images.where(F.col("review_status") == "pending").limit(1).isEmpty()


def require_reviewed(images: DataFrame) -> DataFrame:
    if has_pending(images):
        raise ValueError("image results are still pending review")
    return images


def image_filter(images: DataFrame, kind: str = "", status: str = "", tiny: int = 256) -> DataFrame:
    """Images that are tiny, repeated by content, or not analysed yet; by status."""
    if kind == "tiny":
        images = images.where((F.col("width") <= tiny) | (F.col("height") <= tiny))
    elif kind == "duplicates":
        images = lookup_join(images, duplicate_hashes(images).select("hash_sha256"), ["hash_sha256"], "left_semi")
    elif kind == "not_analysed":
        images = images.where(~F.col("analyzed"))
    return by_values(images, review_status=status)


def duplicate_hashes(images: DataFrame) -> DataFrame:
    """Content hashes that occur more than once; images without a hash are left out."""
    hashed = images.where(has_text(F.col("hash_sha256")))
    return hashed.groupBy("hash_sha256").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def status_counts(df: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """Count per status in a fixed order, zeros and a total included."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])
    return counts.unpivot([], [*statuses, "total"], "status", "n")
