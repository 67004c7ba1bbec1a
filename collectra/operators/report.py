"""Report levels: columns, records, cells, clusters and work packages."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import (
    COUNT_KEYS, action_of, automation_of, rank_severity, severity_rank, title_case,
)
from .checks import Dataset, analyze
from .measures import quality_measures


def _rank() -> Column:
    return severity_rank(F.col("severity"))


def explicit_count() -> Column:
    """First count a finding states itself, null when it states none."""
    return F.coalesce(*[F.try_element_at(F.col("evidence"), F.lit(k)) for k in COUNT_KEYS]).cast("long")


def affected_counts(findings: DataFrame, by: str = "category") -> DataFrame:
    """Affected records per group: sum of stated counts, else distinct ids."""
    stated = findings.groupBy(by).agg(F.sum(explicit_count()).alias("stated"))
    ids = (
        findings.select(by, F.explode("record_ids").alias("record_id")).distinct()
        .groupBy(by).agg(F.count("*").alias("listed"))
    )
    return stated.join(ids, by, "left").select(by, F.coalesce("stated", "listed", F.lit(0)).alias("affected"))


def column_reports(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """Each profiled column with its completeness and the worst of its findings;
    columns named only by findings follow with an empty source."""
    template = F.coalesce(F.col("suggestion"), action_of(F.col("category"), 0))
    per_column = findings.where(F.col("column").isNotNull()).groupBy("column").agg(
        F.min(_rank()).alias("worst"),
        F.min_by(template, F.when(template.isNotNull(), F.struct(_rank(), F.col("ord"), F.col("message")))).alias("suggested_action"),
    )
    known = profile.select(
        F.col("dataset").alias("source"), "column", "fill_rate", "unique_count",
        F.bround(F.round("fill_rate", 4) * 100).cast("int").alias("completeness"),
    )
    joined = known.join(per_column, "column", "left").unionByName(
        per_column.join(known, "column", "left_anti").withColumn("source", F.lit("")), allowMissingColumns=True
    )
    return joined.select(
        "source", "column", "completeness", "fill_rate", "unique_count", "suggested_action",
        F.coalesce(F.col("worst") < 2, F.lit(False)).alias("review_required"),
    )


def record_reports(findings: DataFrame) -> DataFrame:
    """Per listed record: worst severity and messages. Findings list a bounded
    number of ids, so the groups are bounded by the number of findings."""
    listed = findings.select("severity", "message", "ord", F.explode("record_ids").alias("record_id"))
    pairs = F.array_sort(F.collect_list(F.struct("ord", "message")))
    return listed.groupBy("record_id").agg(
        F.min(_rank()).alias("_worst"), F.transform(pairs, lambda p: p["message"]).alias("issues")
    ).select(
        "record_id", rank_severity(F.col("_worst")).alias("severity"), "issues", (F.col("_worst") < 2).alias("review_required")
    )


def sorted_records(reports: DataFrame) -> DataFrame:
    return reports.orderBy(_rank(), "record_id")


def cell_findings(findings: DataFrame) -> DataFrame:
    """Findings about exactly one record and one column."""
    return findings.where(F.col("column").isNotNull() & (F.size("record_ids") == 1)).select(
        F.get("record_ids", 0).alias("record_id"), "column", F.lit(None).cast("string").alias("value"), "severity", "category",
        "message", F.lit(None).cast("double").alias("confidence"), "evidence", F.col("suggestion").alias("suggested_action"),
        (_rank() < 2).alias("review_required"),
    )


def issue_clusters(findings: DataFrame) -> DataFrame:
    """One cluster per category, numbered by worst severity, then name. There
    are at most twenty categories, so the numbering window stays tiny."""
    grouped = findings.groupBy("category").agg(
        F.min(_rank()).alias("_worst"), F.array_sort(F.collect_set("column")).alias("affected_columns")
    )
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_worst", "category")) - 1
    return grouped.join(affected_counts(findings), "category").select(
        F.format_string("cluster_%03d_%s", number, F.col("category")).alias("cluster_id"),
        title_case(F.col("category")).alias("label"), "category", "affected_columns",
        F.col("affected").alias("affected_records"), rank_severity(F.col("_worst")).alias("severity"),
        action_of(F.col("category"), 0).alias("suggested_action"),
    )


def package_candidates(clusters: DataFrame) -> DataFrame:
    """Work to do for every cluster above info."""
    columns = F.col("affected_columns")
    hint = F.when(F.size(columns) > 0, F.concat(
        F.lit(" in "), F.concat_ws(", ", F.slice(columns, 1, 3)), F.when(F.size(columns) > 3, " u.a.").otherwise("")
    )).otherwise("")
    return clusters.where(F.col("severity") != "info").select(
        F.col("label").alias("title"),
        F.concat("label", hint, F.lit(". "), F.col("affected_records").cast("string"), F.lit(" betroffene Records.")).alias("description"),
        F.col("severity").alias("priority"), "affected_columns", F.col("affected_records").alias("estimated_records"),
        F.col("category").alias("action_type"),
    )


def summary(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: findings by severity, datasets, records and columns."""
    from .measures import facts

    return facts(findings, profile).select(
        F.col("n_findings").alias("total_findings"), F.col("n_critical").alias("critical"), F.col("n_warning").alias("warnings"),
        (F.col("n_findings") - F.col("n_critical") - F.col("n_warning")).alias("info"), F.col("n_datasets").alias("datasets_analyzed"),
        F.col("n_records").alias("total_records"), F.col("n_columns").alias("total_columns"),
    )


def quality_report(datasets: list[Dataset]) -> dict[str, DataFrame]:
    """All report levels. The data is read for findings and profiles only."""
    findings, profile = analyze(datasets)
    clusters = issue_clusters(findings)
    return {
        "findings": findings, "profile": profile, "summary": summary(findings, profile),
        "measures": quality_measures(findings, profile), "columns": column_reports(findings, profile),
        "records": record_reports(findings), "cells": cell_findings(findings), "clusters": clusters,
        "packages": package_candidates(clusters),
    }


def work_packages(clusters: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Packages for clusters above info with strategy and automation potential,
    then the report's own candidates; critical first, larger first.

    With a review queue each package counts its items; the links themselves
    are :func:`package_items`.
    """
    columns = F.coalesce(F.nullif(F.concat_ws(", ", "affected_columns"), F.lit("")), F.lit("unbekannte Spalten"))
    main = clusters.where(F.col("severity") != "info").select(
        F.col("label").alias("title"), F.coalesce("suggested_action", F.lit("Befunde manuell prüfen und bereinigen")).alias("description"),
        F.format_string("Betrifft %d Datensätze in Spalten: %s. Kategorie: %s.", F.col("affected_records"), columns, F.col("category")).alias("scope"),
        F.col("category").alias("issue_family"), F.col("severity").alias("priority"), "affected_columns",
        F.col("affected_records").alias("estimated_records"),
        F.coalesce(action_of(F.col("category"), 2), F.lit("manual_review")).alias("action_type"),
        automation_of(F.col("category")).alias("automation_potential"),
        F.coalesce(action_of(F.col("category"), 1), F.lit("Befunde manuell prüfen und bereinigen")).alias("recommended_strategy"),
        F.col("cluster_id").alias("source_cluster_id"),
    )
    own = package_candidates(clusters).select(
        "title", "description",
        F.format_string("Betrifft ~%d Datensätze in: %s", F.col("estimated_records"), F.concat_ws(", ", "affected_columns")).alias("scope"),
        F.col("action_type").alias("issue_family"), "priority", "affected_columns", "estimated_records", "action_type",
        F.lit("medium").alias("automation_potential"), F.col("description").alias("recommended_strategy"),
        F.lit(None).cast("string").alias("source_cluster_id"),
    )
    packages = main.unionByName(own)
    if items is not None:
        counts = package_items(clusters, items).groupBy("cluster_id").agg(F.count("*").alias("item_count"))
        packages = packages.join(
            counts.withColumnRenamed("cluster_id", "source_cluster_id"), "source_cluster_id", "left"
        ).withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return packages.withColumn(
        "package_id", F.sha2(F.concat_ws("|", "issue_family", F.coalesce("source_cluster_id", F.lit("candidate"))), 256)
    )


def sorted_packages(packages: DataFrame) -> DataFrame:
    return packages.orderBy(F.when(F.col("priority") == "critical", 0).otherwise(1), F.col("estimated_records").desc(), "package_id")


def package_items(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """``(cluster_id, item_id)``: items of the same category that stem from no
    cluster, from this one, or that stand for one of its columns as a whole."""
    # one row per category: a fixed-size table
    wanted = F.broadcast(clusters.where(F.col("severity") != "info").select("cluster_id", "category", "affected_columns"))
    ids = F.coalesce("source_issue_ids", F.array().cast("array<string>"))
    linked = (
        (F.size(ids) == 0)
        | F.array_contains(ids, F.col("cluster_id"))
        | (F.array_contains("affected_columns", F.col("column")) & F.col("record_id").isNull())
    )
    return items.join(wanted, "category").where(linked).select("cluster_id", "item_id")


def report_tables(findings: DataFrame, entities: DataFrame | None = None, dates: DataFrame | None = None, dictionary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Count tables of the report, one frame per table."""
    out = {
        "findings_by_severity": findings.groupBy("severity").agg(F.count("*").alias("n")),
        "findings_by_category": findings.groupBy("category", "severity").agg(F.count("*").alias("n")),
    }
    if entities is not None:
        out["entities_by_type_status"] = entities.groupBy("entity_type", "status").agg(F.count("*").alias("n"))
    if dates is not None:
        out["dates_by_method"] = dates.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("edtf") != "").alias("with_edtf"))
    if dictionary is not None:
        out["dictionary_by_type_source"] = dictionary.groupBy("entity_type", "source").agg(F.count("*").alias("n"))
    return out


def combined(frames: dict[str, DataFrame], key: str = "report_table") -> DataFrame:
    """Stack count tables with their name in front."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(key, F.lit(name)) for name, f in frames.items()]
    )
