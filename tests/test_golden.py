"""Fixed cases: dates, names, confidences, cells, filters, thresholds."""
import pytest
from pyspark.sql import functions as F

from collectra.functions import dates, text
from collectra.functions.names import parse_name
from collectra.operators import checks, filters, measures, profile, terms
from collectra.operators.reshape import split_multivalued

DATES = {
    "1920": "1920", "  1950  ": "1950", "0842": "0842", "Januar 1920": "1920-01", "Dez 1945": "1945-12", "1920 März": "1920-03",
    "15.03.1920": "1920-03-15", "1.1.1900": "1900-01-01", "1920/03/15": "1920-03-15", "1920.03.15": "1920-03-15", "1920-03": "1920-03",
    "1920-1930": "1920/1930", "1920–1930": "1920/1930", "1920/1930": "1920/1930", "1920 bis 1930": "1920/1930", "1920 to 1930": "1920/1930",
    "ca. 1920": "1920~", "um 1920": "1920~", "circa 1920": "1920~", "etwa 1920": "1920~", "UNGEFÄHR 1920": "1920~",
    "ca. 1920-1930": "1920~/1930~", "ca. 1920er": "192X~", "1920er": "192X", "1920er Jahre": "192X", "19. Jahrhundert": "18XX",
    "19. Jh.": "18XX", "Anfang 19. Jahrhundert": "18XX", "20. Jahrhundert": "19XX", "1920?": "1920?", "[1920]": "1920?",
    "vor 1920": "../1920", "before 1920": "../1920", "nach 1920": "1920/..", "after 1920": "1920/..", "ab 1920": "1920/..",
    "Sommer 1945": "1945-22", "Winter 1945": "1945-24", "Herbst 1945": "1945-23", "Frühling 1920": "1920-21",
    "o. D.": "", "s.d.": "", "K.A.": "", "ohne  Datum": "", "circa 1920": "1920~", "approx. 1920 - 1930": "1920~/1930~", "2. Jh. v. Chr.": "01XX",
    "Erstes Drittel 19. Jh.": "18XX", "5. century": "04XX", "1920s": "192X", "1925er": "", "BIS 1930": "../1930", "1920 und 1930": "1920/1930",
    "undated": "", "keine Ahnung": "", "": "", "99.99.1920": "1920-99-99", "ca. 1920/03/15": "1920-03-15~",
}


def test_dates(spark):
    df = spark.createDataFrame(list(DATES.items()), "text string, want string")
    got = {r["text"]: r for r in dates.with_dates(df, "text").collect()}
    assert {k: r["edtf"] for k, r in got.items()} == DATES
    assert got["keine Ahnung"]["valid"] is False and got["keine Ahnung"]["confidence"] == 0.0
    assert got["undated"]["note"] == "undatiert" and got[""]["note"] == "leer"
    assert got["Anfang 19. Jahrhundert"]["confidence"] == 0.7 and got["1920–1930"]["note"] == "1920–1930"
    counts = dates.batch_counts(dates.with_dates(df, "text")).first()
    assert (counts["undated"], counts["failed"]) == (6, 2)
    pattern = r"^(|\.\./\d{4}~?|\d{4}~?/\.\.|\d{4}~?/\d{4}~?|\d{3}X~?|\d\dXX~?|\d{4}(-\d\d){0,2}[~?]?)$"
    assert dates.with_dates(df, "text").where(~F.col("edtf").rlike(pattern)).count() == 0


@pytest.mark.parametrize("name,want", [
    ("Goethe, Johann", ("Johann", "Goethe")), ("Johann Wolfgang von Goethe", ("Johann Wolfgang", "von Goethe")), ("von Goethe", ("", "von Goethe")),
    ("Keller", ("", "Keller")), ("Maria de la Cruz", ("Maria", "de la Cruz")), ("  Anna   Meier ", ("Anna", "Meier")),
])
def test_names(spark, name, want):
    row = spark.createDataFrame([(name,)], "n string").select(parse_name(F.col("n")).alias("p")).first()["p"]
    assert tuple(row) == want


def test_confidence_and_cells(spark):
    raw = ["50%", "95%", None, "", "  ", "hoch", "0.85", "85", "x%"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(text.parse_confidence(F.col("v"))).collect()]
    assert got == [0.5, 0.95, 0.0, 0.0, 0.0, 0.0, 0.85, 85.0, 0.0]
    assert spark.range(1).select(text.number_confidence(F.lit(80))).first()[0] == 0.8
    cells = spark.createDataFrame([("  a\t",), ("N/A",), (" nan ",), ("  ",), (None,)], "v string")
    assert [r[0] for r in cells.select(text.clean_cell(F.col("v"))).collect()] == ["a", None, None, None, None]
    nfc = spark.createDataFrame([("  Müller   Anna ",), ("plain  text",)], "v string").select(text.normalize_term(F.col("v"))).collect()
    assert [r[0] for r in nfc] == ["Müller Anna", "plain text"]


def test_json_answers(spark):
    raw = ["```json\n{\"a\": 1}\n```", "﻿[1, 2]", "\"text\"", "3", "broken {", "", None, "```"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").orderBy("i").select(
        F.to_json(text.parse_json(F.col("v")))).collect()]
    assert got == ['{"a":1}', "[1,2]", None, None, None, None, None, None]


def table(spark, rows, schema):
    return profile.Dataset("t", spark.createDataFrame(rows, schema), "record_id")


def test_checks_fixtures(spark):
    gaps = table(spark, [("r1", "A"), ("r2", None), ("r3", "C"), ("r4", None)], "record_id string, title string")
    f = checks.check_missing_values(gaps).collect()
    assert [(x["column"], x["severity"], x["record_ids"]) for x in f] == [("title", "warning", ["r2", "r4"])]
    dup = table(spark, [("r1", "a"), ("r2", "b"), ("r2", "b"), ("r3", "c")], "record_id string, value string")
    f = checks.check_duplicate_records(dup).collect()
    assert (f[0]["severity"], f[0]["evidence"]["duplicate_row_count"], f[0]["record_ids"]) == ("critical", 2.0, ["r2"])
    moji = table(spark, [("r1", "Ã¤pfel"), ("r2", "normal")], "record_id string, title string")
    assert checks.check_encoding_issues(moji).count() == 1
    mixed = table(spark, [("r1", "Berge; Tal"), ("r2", "Fluss, See"), ("r3", "Wald; Wiese, Bach")], "record_id string, tags string")
    assert [x["evidence"] for x in checks.check_format_inconsistency(mixed).collect()] == [{"both_rows": 1.0}]
    terms_ = table(spark, [("1", "Kirche"), ("2", "kirche"), ("3", "KIRCHE"), ("4", "Moschee")], "record_id string, subject string")
    f = checks.check_term_variants(terms_).first()
    assert f["evidence"]["variant_count"] == 1 and f["examples"][0]["forms"] == ["KIRCHE", "Kirche", "kirche"]
    wide = table(spark, [("r1", "g1", "", "90%"), ("r2", None, "API-Abfrage empfohlen", ""), ("r3", "", "api-abfrage empfohlen", None)],
                 "record_id string, named_entity_1_gnd_id string, named_entity_1_gnd_begruendung string, named_entity_1_gnd_konfidenz string")
    assert checks.check_authority_coverage(wide).first()["evidence"]["api_recommended"] == 2
    a = table(spark, [("r1",), ("r2",), ("r3",)], "record_id string")
    b = profile.Dataset("u", spark.createDataFrame([("r2",), ("r3",), ("r4",)], "record_id string"), "record_id")
    found = checks.check_linkage([a, b]).collect()
    assert sorted(x["category"] for x in found) == ["cross_file_mismatch", "orphan_records", "orphan_records"]


@pytest.mark.parametrize("missing,total,severity", [(1, 10, "info"), (11, 100, "warning"), (5, 10, "warning"), (19, 20, "info"), (94, 100, "warning")])
def test_missing_edges(spark, missing, total, severity):
    ds = table(spark, [(str(i), None if i < missing else "x") for i in range(total)], "record_id string, c string")
    assert checks.check_missing_values(ds).first()["severity"] == severity


def test_id_detection(spark):
    code = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "code string, value int")
    none = spark.createDataFrame([("a", "x"), ("a", "x"), ("c", "z")], "code string, value string")
    assert profile.dataset("d", code).id_column == "code" and profile.dataset("d", none).id_column is None
    with pytest.raises(ValueError):
        profile.use_record_id(spark.createDataFrame([("a", "b")], "record_id string, code string"), "code")


def test_measures_on_clean_table(spark):
    ds = table(spark, [("r1", "a"), ("r2", "b"), ("r3", "c")], "record_id string, title string")
    scores = {r["measure"]: r for r in measures.quality_measures(*checks.analyze([ds])).collect()}
    assert scores["completeness"]["score"] == 100 and scores["uniqueness"]["score"] == 100
    assert scores["semantic_correctness"]["score"] == 75 and scores["normalization"]["score"] == 80 and scores["provenance"]["score"] == 70
    assert scores["risk_severity"]["status"] == "good" and len(scores) == 12


def test_multi_values_and_rules(spark):
    df = spark.createDataFrame([("1", "a; b", "x;y"), ("2", None, "z")], "id string, p string, q string")
    rows = sorted((r["id"], r["p"] or "", r["q"]) for r in split_multivalued(df, ["p", "q", "nope"]).collect())
    assert rows == [("1", "a", "x"), ("1", "a", "y"), ("1", "b", "x"), ("1", "b", "y"), ("2", "", "z")]
    kept = filters.apply_rules(df, [{"column": "p", "value": "A|B"}], "id", ["1", "2"])
    assert [r["id"] for r in kept.collect()] == ["1"]


def test_term_scan_paths_agree(spark, monkeypatch):
    words = ["tal", "St. Gallen", "(x", "!?", "alte Mühle", "a", "Tal."]
    known = spark.createDataFrame([(w, "", "", "", i) for i, w in enumerate(words)], "term string, replacement string, category string, note string, ord int")
    values = ["Im Tal.", "Talblick", "St. Gallen (x) !?", "die alte Mühle", "die alte, Mühle", "a", "(x", "wow!?ja", ""]
    cells = spark.createDataFrame([(str(i), "c", v) for i, v in enumerate(values)], "record_id string, column string, value string")
    import re
    edge = r"\s,;.!?\"'()\[\]"
    want = {(str(i), w) for i, v in enumerate(values) for w in words if re.search(rf"(?<![^{edge}])" + re.escape(w.lower()) + rf"(?![^{edge}])", v.lower())}
    assert {(r["record_id"], r["term"]) for r in terms.scan_terms(cells, known).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(terms, "MAX_INLINE_WORDS", 0)
        assert {(r["record_id"], r["term"]) for r in terms.scan_terms(cells, known).collect()} == want
    want = {(str(i), w) for i, v in enumerate(values) for w in words if w.lower() in v.lower()}
    assert {(r["record_id"], r["term"]) for r in terms.scan_terms(cells, known, whole_word=False).collect()} == want
    monkeypatch.setattr(terms, "MAX_INLINE_TERMS", 0)
    assert {(r["record_id"], r["term"]) for r in terms.scan_terms(cells, known, whole_word=False).collect()} == want
