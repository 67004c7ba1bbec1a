"""Twelve quality scores from findings and profiles.

Both inputs are report-sized (rows per column and check, not per record). They
are reduced to one row of facts, from which every score is an expression.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import severity_rank, status_of_score
from .joins import top_rows

# FIXED VALUES: measure keys in report order, with the categories they score.
MEASURES = {
    "completeness": ["missing_values"],
    "uniqueness": ["duplicate_records", "near_duplicate_records"],
    "structural_validity": ["encoding_issues", "format_inconsistency", "schema_mismatch"],
    "consistency": ["term_variants", "format_inconsistency", "classification_inconsistency"],
    "semantic_correctness": ["field_misuse", "classification_inconsistency", "ambiguous_value"],
    "normalization": ["term_variants", "norm_data_candidate", "gnd_match_missing"],
    "clarity": ["low_information_value", "ambiguous_value"],
    "cross_field_coherence": ["cross_field_conflict", "cross_file_mismatch", "orphan_records"],
    "provenance": ["provenance_gap", "gnd_match_missing", "geo_enrichment_candidate"],
    "fitness_for_use": ["missing_values", "duplicate_records", "encoding_issues", "format_inconsistency", "schema_mismatch"],
    "risk_severity": ["all"],
    "actionability": ["remediation_candidate"],
}


def _value(key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("evidence"), F.lit(key)), F.lit(0.0))


def facts(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """One row with everything the scores need."""
    cat, sev = F.col("category"), F.col("severity")
    counted = {f"n_{c}": F.count_if(cat == c) for c in sorted({c for cs in MEASURES.values() for c in cs if c != "all"})}
    coverage = F.try_element_at(F.col("evidence"), F.lit("coverage_rate"))
    structural = cat.isin(MEASURES["structural_validity"])
    near = F.coalesce(F.try_element_at(F.col("evidence"), F.lit("near_duplicate_count")), F.size("record_ids").cast("double"))
    from_findings = findings.agg(
        *[v.alias(k) for k, v in counted.items()],
        F.count("*").alias("n_findings"),
        F.count_if(sev == "critical").alias("n_critical"),
        F.count_if(sev == "warning").alias("n_warning"),
        F.count_if(F.coalesce(F.col("suggestion"), F.lit("")) != "").alias("n_suggested"),
        F.sum(_value("missing_count")).alias("missing"),
        F.sum(_value("duplicate_row_count")).alias("duplicates"),
        F.sum(F.when(cat == "near_duplicate_records", near).otherwise(0.0)).alias("near_duplicates"),
        F.sum(_value("variant_count")).alias("variants"),
        F.sum(F.when(cat == "orphan_records", _value("orphan_count")).otherwise(0.0)).alias("orphans"),
        F.sum(F.when(cat == "gnd_match_missing", _value("no_match_count")).otherwise(0.0)).alias("no_match"),
        F.sum(F.when(structural, F.when(sev == "critical", 20).when(sev == "warning", 10).otherwise(3)).otherwise(0)).alias("structural_penalty"),
        F.count_if((cat == "cross_file_mismatch") & (sev != "info")).alias("bad_links"),
        F.min_by(coverage, F.when(coverage.isNotNull(), F.col("ord"))).alias("coverage"),
    )
    per_dataset = profile.groupBy("dataset").agg(
        F.count("*").alias("cols"), F.max("total_count").alias("rows"), F.sum(F.round("fill_rate", 4)).alias("rates")
    )
    from_profile = per_dataset.agg(
        F.count("*").alias("n_datasets"), F.sum("cols").alias("n_columns"), F.sum("rows").alias("n_records"), F.sum("rates").alias("rate_sum")
    )
    both = from_findings.unionByName(from_profile, allowMissingColumns=True)
    sums = [F.max(c).alias(c) for c in both.columns]
    zero_less = {"coverage", "rate_sum"}
    return both.agg(*sums).select(*[F.col(c) if c in zero_less else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in both.columns])


def _floor0(c: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(c).cast("int"))


def _capped(penalty: Column, cap: int = 80) -> Column:
    return F.lit(100) - F.least(F.lit(cap), penalty)


def scores() -> dict[str, tuple[Column, Column]]:
    """Measure -> (score, evidence count) as expressions over :func:`facts`."""
    def n(category: str) -> Column:
        return F.col(f"n_{category}")

    c = F.col
    has_data, whole = c("n_datasets") > 0, F.lit(100.0)
    completeness = F.when(c("n_columns") > 0, F.bround(c("rate_sum") / c("n_columns") * 100).cast("int"))
    penalty = c("duplicates") / c("n_records") * 100 + c("near_duplicates") / c("n_records") * 50
    uniqueness = F.when(c("n_records") > 0, _floor0(whole - penalty))
    structural = F.when(c("n_columns") > 0, F.greatest(F.lit(0), F.lit(100) - c("structural_penalty")).cast("int"))
    n_structural = reduce(lambda a, b: a + b, [n(k) for k in MEASURES["structural_validity"]])
    fmt = F.when(n("format_inconsistency") > 0, 10).otherwise(0)
    consistency = F.when(c("n_columns") > 0, _floor0(_capped(c("variants") * 5 + n("classification_inconsistency") * 10 + fmt)))
    semantic_n = n("field_misuse") + n("classification_inconsistency") + n("ambiguous_value")
    semantic_penalty = n("field_misuse") * 15 + n("classification_inconsistency") * 10 + n("ambiguous_value") * 5
    semantic = F.when(has_data, F.when(semantic_n == 0, 75).otherwise(_floor0(_capped(semantic_penalty))))
    relevant = (n("term_variants") + n("norm_data_candidate") + n("gnd_match_missing")) > 0
    normalization = F.when(
        has_data | relevant,
        F.when(c("coverage").isNotNull(), F.greatest(F.lit(0), F.bround(c("coverage") * 100).cast("int") - F.least(F.lit(30), c("variants") * 3).cast("int")))
        .when(n("term_variants") > 0, _floor0(F.lit(100) - c("variants") * 5))
        .otherwise(80),
    )
    clarity_n = n("low_information_value") + n("ambiguous_value")
    clarity = F.when(has_data, F.when(clarity_n == 0, 80).otherwise(
        _floor0(_capped(n("low_information_value") * 10 + n("ambiguous_value") * 5))
    ))
    link_n = n("cross_field_conflict") + n("cross_file_mismatch") + n("orphan_records")
    coherence = F.when(
        has_data | (link_n > 0),
        _floor0(_capped(n("cross_field_conflict") * 15 + n("orphan_records") * 10 + c("bad_links") * 5)),
    )
    proven = (n("provenance_gap") + n("gnd_match_missing") + n("geo_enrichment_candidate")) > 0
    provenance = F.when(
        has_data | proven,
        F.when(c("coverage").isNotNull(), F.greatest(F.lit(0), F.bround(c("coverage") * 100).cast("int") - (n("provenance_gap") * 10).cast("int")))
        .when(n("provenance_gap") > 0, _floor0(F.lit(100) - n("provenance_gap") * 15))
        .otherwise(70),
    )
    parts = F.filter(F.array(completeness, uniqueness, structural), lambda x: x.isNotNull())
    fitness = F.when(F.size(parts) > 0, F.bround(F.aggregate(parts, F.lit(0), lambda a, x: a + x) / F.size(parts)).cast("int"))
    risk_raw = _floor0(whole - c("n_critical") / c("n_findings") * 80 - c("n_warning") / c("n_findings") * 30)
    risk = F.when(c("n_findings") == 0, 100).otherwise(F.when(c("n_critical") > 0, F.least(risk_raw, F.lit(49))).otherwise(risk_raw))
    action = F.when(c("n_findings") == 0, 100).otherwise(F.bround(c("n_suggested") / c("n_findings") * 100).cast("int"))
    return {
        "completeness": (completeness, c("missing")),
        "uniqueness": (uniqueness, c("duplicates")),
        "structural_validity": (structural, n_structural),
        "consistency": (consistency, c("variants") + n("classification_inconsistency") + n("format_inconsistency")),
        "semantic_correctness": (semantic, semantic_n),
        "normalization": (normalization, c("variants") + c("no_match")),
        "clarity": (clarity, clarity_n),
        "cross_field_coherence": (coherence, c("orphans") + n("cross_field_conflict")),
        "provenance": (provenance, n("provenance_gap") + c("no_match")),
        "fitness_for_use": (fitness, F.lit(0)),
        "risk_severity": (risk, c("n_critical") + c("n_warning")),
        "actionability": (action, c("n_suggested")),
    }


# FIXED VALUES: recommended actions, and when they apply (over facts and scores).
def _actions() -> dict[str, list[tuple[Column, str]]]:
    c = F.col

    def some(category: str) -> Column:
        return c(f"n_{category}") > 0

    low = c("coverage").isNull()
    return {
        "completeness": [(some("missing_values"), "Pflichtfelder prüfen und fehlende Werte ergänzen")],
        "uniqueness": [
            (some("duplicate_records"), "Duplikate identifizieren und zusammenführen oder entfernen"),
            (some("near_duplicate_records"), "Near-Duplicate-Kandidaten manuell prüfen"),
        ],
        "structural_validity": [
            (some("encoding_issues"), "Encoding-Artefakte bereinigen (UTF-8 Standardisierung)"),
            (some("format_inconsistency"), "Delimiter-Inkonsistenzen und Whitespace korrigieren"),
            (some("schema_mismatch"), "Schema-Abweichungen prüfen und Pflichtfelder ergänzen"),
        ],
        "consistency": [
            (some("term_variants"), "Term-Varianten normalisieren (Groß-/Kleinschreibung vereinheitlichen)"),
            (some("classification_inconsistency"), "Klassifikationswerte auf kontrolliertes Vokabular prüfen"),
            (some("format_inconsistency"), "Format-Inkonsistenzen bereinigen"),
        ],
        "normalization": [
            (some("gnd_match_missing") & (low | (c("coverage") < 0.8)), "GND-Verlinkung vervollständigen (API-Lookup empfohlen)"),
            (some("term_variants"), "Term-Varianten auf Normdaten-Entsprechungen abbilden"),
        ],
        "cross_field_coherence": [
            (some("orphan_records"), "Verwaiste Records auf Verknüpfungsfehler prüfen und korrigieren"),
            (some("cross_file_mismatch"), "Datei-übergreifende Verknüpfungen validieren"),
        ],
        "provenance": [
            (some("gnd_match_missing") & (low | (c("coverage") < 0.7)), "GND-Normdaten ergänzen (Autorität, Herkunft belegen)"),
        ],
        "risk_severity": [
            (c("n_critical") > 0, "Kritische Findings vor Export oder Publikation beheben"),
            (c("n_warning") > 0, "Warnungen in Arbeitspaket-Planung berücksichtigen"),
        ],
        "actionability": [(c("n_findings") > 0, "Findings nach Priorität in Arbeitspakete überführen")],
    }


def quality_measures(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """Twelve rows: measure, score, status, evidence count, actions."""
    actions = _actions()
    rows = []
    for i, (name, (score, count)) in enumerate(scores().items()):
        texts = [F.when(when, F.lit(text)) for when, text in actions.get(name, [])]
        rows.append(F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("measure"), score.cast("int").alias("score"),
            status_of_score(score).alias("status"), F.when(score.isNull(), 0).otherwise(count).cast("long").alias("evidence_count"),
            F.filter(F.array(*texts) if texts else F.array().cast("array<string>"), lambda t: t.isNotNull()).alias("actions"),
        ))
    return facts(findings, profile).select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def measure_examples(findings: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` findings per measure: largest counts first, then worst severity."""
    owners = F.array(*[
        F.when(F.col("category").isin(cats) if cats != ["all"] else F.col("severity") == "critical", F.lit(name))
        for name, cats in MEASURES.items()
    ])
    owned = findings.withColumn("measure", F.explode(F.filter(owners, lambda o: o.isNotNull())))
    order = [
        F.when(F.col("measure") == "completeness", _value("missing_count")).otherwise(0.0).desc(),
        severity_rank(F.col("severity")), F.col("ord"), F.col("column"), F.col("message"),
    ]
    return top_rows(owned, ["measure"], order, n, "pos").select(
        "measure", "pos", "category", "severity", "column", "message", "evidence"
    )
