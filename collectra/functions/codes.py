"""Code lists and lookup tables.

FIXED VALUES: the entries below are part of the data format (codes, weights,
suggested actions) and have to be exactly these for results to agree.
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["critical", "warning", "info"]
REVIEW_STATUSES = ["pending", "accepted", "rejected", "needs_expert_review", "applied"]
IMAGE_STATUSES = ["pending", "accepted", "rejected"]

# Entity code -> dictionary type.
ENTITY_TO_DICTIONARY = {
    "PER": "person", "ORG": "institution", "LOC": "place", "GPE": "place",
    "FAC": "place", "EVT": "event", "WRK": "work", "CON": "concept",
    "ETH": "concept", "DAT": "other", "TOP": "concept",
}
# Entity code -> German label.
ENTITY_LABELS = {
    "PER": "Person", "ORG": "Organisation", "LOC": "Ort/Geografie",
    "GPE": "Geo-politische Einheit", "FAC": "Bauwerk/Einrichtung",
    "EVT": "Ereignis", "WRK": "Werk/Publikation", "DAT": "Datum/Zeit",
    "ETH": "Ethnie/Kulturgruppe", "CON": "Konzept/Thema", "TOP": "Thema/Schlagwort",
}
# Entity code -> schema.org type.
ENTITY_TO_SCHEMA = {
    "PER": "Person", "ORG": "Organization", "LOC": "Place", "GPE": "Place",
    "FAC": "LandmarksOrHistoricalBuildings", "EVT": "Event", "WRK": "CreativeWork",
    "DAT": "DateTime", "ETH": "Audience", "CON": "DefinedTerm",
}
# Tagger label -> entity code; anything else is CON.
TAGGER_TO_ENTITY = {
    "PER": "PER", "PERSON": "PER", "ORG": "ORG", "LOC": "LOC", "GPE": "GPE",
    "FAC": "FAC", "EVENT": "EVT", "WORK_OF_ART": "WRK", "DATE": "DAT",
    "NORP": "ETH", "MISC": "CON",
}
# Dictionary type -> entity code in the hand-over format.
DICTIONARY_TO_CODE = {
    "place": "LOC", "person": "PER", "institution": "ORG", "concept": "CON",
    "event": "EVT", "work": "WRK", "other": "CON",
}
# Entity code -> authority type.
ENTITY_TO_AUTHORITY = {
    "PER": "Person", "ORG": "CorporateBody", "LOC": "PlaceOrGeographicName",
    "GPE": "PlaceOrGeographicName", "FAC": "BuildingOrMemorial",
    "EVT": "HistoricSingleEventOrEra", "WRK": "Work", "CON": "SubjectHeading",
}
# Entity code -> column of the enriched CSV. TOP has none.
ENTITY_COLUMNS = {
    "PER": "ner_persons", "ORG": "ner_organisations", "LOC": "ner_places",
    "GPE": "ner_geo_political", "FAC": "ner_buildings", "EVT": "ner_events",
    "WRK": "ner_works", "DAT": "ner_dates_raw", "ETH": "ner_ethnic_groups",
    "CON": "ner_concepts",
}
# Issue type of a model answer -> finding category.
ISSUE_TO_CATEGORY = {
    "semantic_misplacement": "field_misuse", "ambiguous": "ambiguous_value",
    "generic": "low_information_value", "encoding_artifact": "encoding_issues",
    "review_required": "remediation_candidate", "cross_field_conflict": "cross_field_conflict",
}
ANSWER_SEVERITY = {"critical": "critical", "warning": "warning", "info": "info", "ok": "info"}

# Category -> (suggested action, strategy, action type).
CATEGORY_ACTIONS = {
    "missing_values": ("Fehlende Werte in betroffenen Spalten ergänzen", "Fehlende Werte ergänzen oder Felder als optional markieren", "fill_missing"),
    "duplicate_records": ("Duplikate identifizieren und bereinigen", "Duplikate zusammenführen oder löschen", "deduplicate"),
    "encoding_issues": ("Encoding-Artefakte durch UTF-8-Standardisierung beheben", "Encoding-Artefakte bereinigen (UTF-8 normalisieren)", "normalize_encoding"),
    "format_inconsistency": ("Delimiter- und Whitespace-Inkonsistenzen korrigieren", "Einheitliches Format erzwingen (Trennzeichen, Leerzeichen)", "normalize_format"),
    "schema_mismatch": ("Schema-Abweichungen prüfen und Pflichtfelder ergänzen", "Schema-Abweichungen bereinigen", "manual_review"),
    "term_variants": ("Term-Varianten durch kontrolliertes Vokabular vereinheitlichen", "Varianten auf Vorzugsbenennung normalisieren", "normalize_label"),
    "classification_inconsistency": ("Klassifikationswerte anhand von Normdaten verifizieren", "Klassifikation vereinheitlichen", "manual_review"),
    "gnd_match_missing": ("GND-Normdatenverknüpfung für betroffene Spalten ergänzen", "GND-Normdaten zuordnen (lobid.org)", "flag_for_authority_lookup"),
    "orphan_records": ("Verwaiste Records auf Verknüpfungsfehler prüfen", "Verwaiste Datensätze prüfen und verknüpfen oder löschen", "manual_review"),
    "cross_field_conflict": ("Widersprüchliche Feldwerte identifizieren und bereinigen", "Konfligierende Felder gemeinsam prüfen und abstimmen", "review_conflict"),
    "provenance_gap": ("Fehlende Herkunftsnachweise durch Quellenangaben ergänzen", "Fehlende Provenienzinformationen nacherfassen", "fill_missing"),
    "near_duplicate_records": ("Near-Duplicate-Kandidaten manuell prüfen", "Ähnliche Datensätze manuell prüfen und zusammenführen", "review_near_duplicates"),
    "ambiguous_value": ("Mehrdeutige Werte durch Kontextzusätze präzisieren", "Ambige Werte einzeln prüfen und klären", "flag_for_review"),
    "low_information_value": ("Felder mit niedrigem Informationswert anreichern", "Informationsarme Werte prüfen und ggf. löschen", "manual_review"),
    "remediation_candidate": ("Automatisch behebbare Findings priorisieren", "Bereinigungsvorschläge prüfen und anwenden", "apply_suggested_value"),
    "norm_data_candidate": ("Normalisierungskandidaten in standardisiertes Vokabular überführen", "Normdaten-Kandidaten prüfen und verknüpfen", "flag_for_authority_lookup"),
    "geo_enrichment_candidate": ("Geografische Normdaten (Geonames) anreichern", "Geografische Anreicherung via GeoNames prüfen", "flag_for_authority_lookup"),
    "cross_file_mismatch": ("Datei-übergreifende Verknüpfungen validieren", "Datensatz-übergreifende Inkonsistenzen auflösen", "manual_review"),
    "language_mixing": ("Sprachmischungen in Metadatenfeldern bereinigen", "Sprachmischungen prüfen und trennen", "manual_review"),
    "field_misuse": ("Fehlplatzierte Werte in korrekte Felder verschieben", "Werte in korrekte Zielspalte verschieben", "move_value_to_field"),
}
HIGH_AUTOMATION = ["missing_values", "encoding_issues", "format_inconsistency", "duplicate_records", "near_duplicate_records"]
MEDIUM_AUTOMATION = ["term_variants", "norm_data_candidate", "gnd_match_missing", "geo_enrichment_candidate", "remediation_candidate"]

# Evidence keys that hold a count of records, in order of preference.
REMEDIATION_ACTIONS = [
    "move_value_to_field", "split_multi_value", "normalize_label",
    "flag_for_authority_lookup", "leave_unchanged_mark_uncertain", "apply_suggested_value",
]
COUNT_KEYS = ["missing_count", "duplicate_row_count", "orphan_count", "near_duplicate_count", "affected_count", "no_match_count"]


def mapped(c: Column, table: dict[str, str], default: Column | str | None = None) -> Column:
    """Constant lookup, evaluated inside the projection."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(lookup, c)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "warning", 1).otherwise(2)


def rank_severity(c: Column) -> Column:
    return F.when(c == 0, "critical").when(c == 1, "warning").when(c == 2, "info")


def status_of_score(c: Column) -> Column:
    return (
        F.when(c.isNull(), "insufficient_data").when(c >= 80, "good").when(c >= 50, "needs_review").otherwise("critical")
    )


def scope_of(n: Column) -> Column:
    return (
        F.when(n == 0, "dataset-level").when(n == 1, "single-record").otherwise(F.concat(n.cast("string"), F.lit(" records")))
    )


def action_of(category: Column, which: int) -> Column:
    return mapped(category, {k: v[which] for k, v in CATEGORY_ACTIONS.items()})


def automation_of(category: Column) -> Column:
    return F.when(category.isin(HIGH_AUTOMATION), "high").when(category.isin(MEDIUM_AUTOMATION), "medium").otherwise("low")


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# Authority source -> (URI prefix, label in the hand-over format).
AUTHORITY_SOURCES = {
    "gnd": ("https://d-nb.info/gnd/", "GND: "),
    "wikidata": ("https://www.wikidata.org/wiki/", "Wikidata: "),
    "geonames": ("https://www.geonames.org/", "GeoNames: "),
}


def authority_uri(source: Column, authority_id: Column) -> Column:
    has = F.coalesce(authority_id, F.lit("")) != ""
    prefix = mapped(source, {k: v[0] for k, v in AUTHORITY_SOURCES.items()})
    return F.when(has, F.concat(prefix, authority_id)).otherwise("")


def authority_label(gnd: Column, wikidata: Column, geonames: Column) -> Column:
    """First authority id present, with the name of its source in front."""
    ids = {"gnd": gnd, "wikidata": wikidata, "geonames": geonames}
    parts = [
        F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(AUTHORITY_SOURCES[s][1]), c)) for s, c in ids.items()
    ]
    return F.coalesce(*parts, F.lit(""))


def provenance(**given: Column) -> Column:
    """Uniform seven-field struct, empty text for what is absent."""
    keys = ["source", "method", "model", "extracted_at", "reviewed_at", "reviewer", "note"]
    return F.struct(*[F.coalesce(given.get(k, F.lit("")).cast("string"), F.lit("")).alias(k) for k in keys])


# FIXED VALUES: sources of a mention that are also the name of its method.
MENTION_METHODS = ("llm", "spacy", "rule", "manual")


def row_provenance(kind: str, df: DataFrame) -> Column:
    """Where a row comes from: a ``dictionary`` entry, ``mention``, ``date``, authority ``candidate`` or
    ``image`` result. Columns that the table lacks count as empty."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    def either(first: str, second: str) -> Column:
        return F.when(text(first) != "", text(first)).otherwise(text(second))

    given = {name: text(name) for name in ("source", "model", "extracted_at", "reviewed_at", "reviewer", "note")}
    own = {
        "dictionary": {"method": text("source"), "model": text("model_source"), "extracted_at": F.lit(""), "reviewed_at": text("last_edited"), "reviewer": F.lit("")},
        "mention": {"method": F.when(text("source").isin(*MENTION_METHODS), text("source")).otherwise("ner"), "note": either("editor_note", "reviewer_note")},
        "date": {"source": either("source", "method"), "method": text("method")},
        "candidate": {"method": F.lit("api"), "note": text("reviewer_note")},
        "image": {"source": F.lit("vision_ai"), "method": F.lit("llm"), "extracted_at": text("analyzed_at"), "note": either("review_note", "review_comment")},
    }
    return provenance(**given | own[kind])
