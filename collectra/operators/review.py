"""Review queue, decisions, gates and suggestions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import IMAGE_STATUSES, REMEDIATION_ACTIONS, REVIEW_STATUSES
from ..functions.text import has_text
from .filters import status_counts
from .joins import lookup_join

ITEM_COLUMNS = [
    "source", "record_id", "column", "original_value", "category", "severity", "confidence", "message", "reasoning",
    "suggested_action", "source_issue_ids", "is_ai_based",
]


def _item(df: DataFrame, level: str, source: str, is_ai: bool, **fields: Column) -> DataFrame:
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    defaults = {
        "source": F.lit(source), "record_id": text, "column": text, "original_value": text, "confidence": F.lit(None).cast("double"),
        "reasoning": F.lit(""), "suggested_action": text, "source_issue_ids": none, "is_ai_based": F.lit(is_ai),
    }
    values = {**defaults, **fields}
    rows = df.select(*[values[c].alias(c) for c in ITEM_COLUMNS])
    key = F.concat_ws("|", F.lit(level), "source", "record_id", "column", "category", "message")
    return rows.withColumn("item_id", F.sha2(key, 256)).withColumn("status", F.lit("pending"))


def build_queue(cells: DataFrame, records: DataFrame, clusters: DataFrame, source: str = "", is_ai: bool = False) -> DataFrame:
    """Items for every cell finding, every record that needs review and every
    cluster above info. Ids are hashes of the content, so a rerun gives the same."""
    c = F.col
    cell_items = _item(
        cells, "cell", source, is_ai, record_id=c("record_id"), column=c("column"), original_value=c("value"), category=c("category"),
        severity=c("severity"), confidence=c("confidence"), message=c("message"), suggested_action=c("suggested_action"),
    )
    record_items = _item(
        records.where("review_required"), "record", source, is_ai, record_id=c("record_id"), category=F.lit("cross_field_conflict"),
        severity=F.coalesce("severity", F.lit("warning")), message=F.concat_ws("; ", "issues"),
    )
    reasoning = F.format_string("Cluster betrifft %d Datensätze in Spalten: %s", c("affected_records"), F.concat_ws(", ", "affected_columns"))
    cluster_items = _item(
        clusters.where("severity <> 'info'"), "cluster", source, False, column=F.get("affected_columns", 0), category=c("category"),
        severity=c("severity"), message=c("label"), reasoning=reasoning, suggested_action=c("suggested_action"),
        source_issue_ids=F.array("cluster_id"),
    )
    return cell_items.unionByName(record_items).unionByName(cluster_items)


def apply_decisions(items: DataFrame, decisions: DataFrame, key: str = "item_id", status: str = "status") -> DataFrame:
    """Items with the latest decision about each; the log itself only grows."""
    latest = decisions.groupBy(key).agg(F.max_by(F.struct("decision", "reviewer", "note"), "ord").alias("_d"))
    joined = lookup_join(items, latest, [key], "left")
    values = {status: F.coalesce("_d.decision", status)}
    for new, field in (("reviewer", "reviewer"), ("reviewer_note", "note")):
        values[new] = F.coalesce(F.col(f"_d.{field}"), F.col(new) if new in items.columns else F.lit(None).cast("string"))
    return joined.withColumns(values).drop("_d")


def decision_log(log: DataFrame, decisions: DataFrame) -> DataFrame:
    return log.unionByName(decisions, allowMissingColumns=True)


def queue_summary(items: DataFrame) -> DataFrame:
    """Counts by status, severity and category, and the total, in one pass."""
    facets = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value")),
        *[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("status", "severity", "category")],
    )
    return items.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def gate_status(images: DataFrame, mentions: DataFrame, candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Status counts of the three review gates and the dictionary."""
    from .authority import enrichment

    gates = [
        ("1_ocr", status_counts(images, "review_status", IMAGE_STATUSES)),
        ("2_ner", status_counts(mentions, "status", IMAGE_STATUSES)),
        ("3_authority", status_counts(candidates, "status", IMAGE_STATUSES)),
        ("dictionary", enrichment(entries).unpivot([], ["total", "enriched", "unenriched"], "status", "n")),
    ]
    out = None
    for name, counts in gates:
        part = counts.withColumn("phase", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def correct_results(images: DataFrame, corrections: DataFrame) -> DataFrame:
    """Merge manual corrections into result maps (``map<string,string>``), a
    corrected key replacing the old one; status and comment follow."""
    joined = lookup_join(images, corrections.withColumnsRenamed({"updates": "_u", "status": "_s", "comment": "_c"}), ["image_id"], "left")
    merged = F.when(F.col("_u").isNull(), F.col("result")).otherwise(
        F.map_zip_with("result", "_u", lambda k, old, new: F.coalesce(new, old))
    )
    return joined.withColumns({
        "result": merged, "review_status": F.coalesce("_s", "review_status"), "review_comment": F.coalesce("_c", "review_comment")
    }).drop("_u", "_s", "_c")


def checked_suggestions(suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) suggestions; refused rows say why."""
    reason = (
        F.when(~F.coalesce(F.col("action_type").isin(REMEDIATION_ACTIONS), F.lit(False)), "unknown action")
        .when(~F.coalesce(F.col("status").isin(REVIEW_STATUSES), F.lit(False)), "unknown status")
        .when(~has_text(F.coalesce("suggestion_id", F.lit(""))), "no id")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range")
    )
    marked = suggestions.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
