"""Dates, text functions and term scans."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs
from ..functions import codes, dates, text
from ..functions.names import parse_name
from ..operators import profile, terms
from .quality import COLLECTION, CELLS, collection
from .registry import query

_T = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_APPROX = "(?i)^(ca\\.?|circa|um|ungef[aä]hr|approx\\.?|etwa)\\s*"
_MONTHS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dates.MONTHS.items()) + "}"
_SEASONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dates.SEASONS.items()) + "}"
DATES_SQL = inputs.cte("date_texts") + f""", stripped AS (
SELECT *, {_T} AS original, trim(regexp_replace({_T}, '{_APPROX}', '')) AS t,
  CASE WHEN regexp_matches({_T}, '{_APPROX}') THEN '~' ELSE '' END AS q FROM date_texts),
named AS (SELECT *, lower(coalesce(nullif(regexp_extract(t, '^(\\p{{L}}+)\\s+(\\d{{4}})$', 1), ''), regexp_extract(t, '^(\\d{{4}})\\s+(\\p{{L}}+)$', 2))) AS w,
  coalesce(nullif(regexp_extract(t, '^(\\p{{L}}+)\\s+(\\d{{4}})$', 2), ''), regexp_extract(t, '^(\\d{{4}})\\s+(\\p{{L}}+)$', 1)) AS y FROM stripped),
edtf AS (SELECT record_id, ord, original, CASE
  WHEN original = '' THEN ''
  WHEN regexp_matches(original, '(?i)^(o\\.?\\s*[dj]\\.?|undatiert|undated|s\\.?\\s*d\\.?|ohne datum|keine angabe|n\\.?\\s*d\\.?|unbekannt|k\\.a\\.)$') THEN ''
  WHEN regexp_matches(t, '^\\[\\d{{4}}\\]$') THEN t[2:5] || '?'
  WHEN regexp_matches(t, '^\\d{{4}}\\?$') THEN t
  WHEN regexp_matches(t, '(?i)^(vor|before|bis|ante)\\s+\\d{{4}}') THEN '../' || regexp_extract(t, '\\s(\\d{{4}})', 1) || q
  WHEN regexp_matches(t, '(?i)^(nach|after|ab|seit|post)\\s+\\d{{4}}') THEN regexp_extract(t, '\\s(\\d{{4}})', 1) || q || '/..'
  WHEN regexp_matches(t, '(?i)^\\d{{4}}(\\s*[-–—/]\\s*|\\s+(bis|to|und|and)\\s+)\\d{{4}}$') THEN t[1:4] || q || '/' || right(t, 4) || q
  WHEN regexp_matches(t, '(?i)^\\d{{3}}0\\s*-?(er|er\\s+jahre|s)$') THEN t[1:3] || 'X' || q
  WHEN regexp_matches(t, '(?i)^(anfang|beginn|mitte|ende)?\\s*\\d{{1,2}}\\.\\s*(jh|jahrhundert|century)') THEN lpad(cast(cast(regexp_extract(t, '(\\d{{1,2}})\\.', 1) AS INTEGER) - 1 AS VARCHAR), 2, '0') || 'XX' || q
  WHEN regexp_matches(t, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') THEN right(t, 4) || '-' || lpad(string_split(t, '.')[2], 2, '0') || '-' || lpad(string_split(t, '.')[1], 2, '0') || q
  WHEN regexp_matches(t, '^\\d{{4}}[/.]\\d{{2}}[/.]\\d{{2}}$') THEN t[1:4] || '-' || t[6:7] || '-' || t[9:10] || q
  WHEN regexp_matches(t, '^\\d{{4}}(-\\d{{2}}){{0,2}}$') THEN t || q
  WHEN {_MONTHS}[w] IS NOT NULL THEN y || '-' || {_MONTHS}[w] || q
  WHEN {_SEASONS}[w] IS NOT NULL THEN y || '-' || {_SEASONS}[w] || q ELSE NULL END AS edtf FROM named)"""


@query("date_normalization", f"WITH {DATES_SQL} SELECT record_id, original, coalesce(edtf, '') AS edtf, edtf IS NOT NULL AS valid FROM edtf")
def date_normalization(spark, sf_dir):
    d = inputs.derive(spark, sf_dir, "date_texts")
    return dates.with_dates(d, "text").select("record_id", "original", "edtf", "valid")


@query("date_confidence", f"""WITH {DATES_SQL} SELECT
  CASE WHEN edtf IS NULL THEN 'none' WHEN edtf = '' THEN 'undated' ELSE 'dated' END AS kind,
  CASE WHEN edtf IS NULL THEN 0 WHEN edtf = '' THEN 100 WHEN starts_with(original, 'Anfang') THEN 70 WHEN contains(original, 'Jh.') THEN 85
    WHEN regexp_matches(original, '^(vor|NACH|Sommer)|Jahre$') THEN 90 WHEN regexp_matches(original, '^\\[|^Mai| Dez$|bis|-2010$') THEN 95 ELSE 100 END AS confidence_pct,
  count(*) AS n FROM edtf GROUP BY ALL""")
def date_confidence(spark, sf_dir):
    d = dates.with_dates(inputs.derive(spark, sf_dir, "date_texts"), "text")
    kind = F.when(~F.col("valid"), "none").when(F.col("edtf") == "", "undated").otherwise("dated")
    return d.groupBy(kind.alias("kind"), F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct")).agg(F.count("*").alias("n"))


@query("date_batch_counts", f"""WITH {DATES_SQL} SELECT count(*) AS total, count(*) FILTER (edtf <> '') AS converted,
  count(*) FILTER (edtf IS NULL) AS failed, count(*) FILTER (edtf = '') AS undated, count(*) FILTER (edtf <> '') / count(*) AS success_rate FROM edtf""")
def date_batch_counts(spark, sf_dir):
    return dates.batch_counts(dates.with_dates(inputs.derive(spark, sf_dir, "date_texts"), "text"))


@query("date_rules_unresolved", f"WITH {DATES_SQL} SELECT record_id, original AS text FROM edtf WHERE edtf IS NULL")
def date_rules_unresolved(spark, sf_dir):
    return dates.rule_dates(inputs.derive(spark, sf_dir, "date_texts"))[1].select("record_id", text.strip(F.col("text")).alias("text"))


_PARTICLES = "|".join(["von", "vom", "zu", "zur", "van", "ten", "ter", "der", "de", "du", "des", "le", "la", "del", "della", "di", "da", "dal", "dalla", "lo", "los", "las"])


@query("name_parts", f"""WITH {COLLECTION}, names AS (
SELECT DISTINCT trim(unnest(string_split(creator, ';'))) AS name FROM collection WHERE creator IS NOT NULL)
SELECT name, CASE WHEN contains(name, ',') THEN trim(substr(name, strpos(name, ',') + 1))
    ELSE trim(regexp_replace(name, '(?i)(^|\\s)(({_PARTICLES})\\s+)*\\S+$', '')) END AS firstname,
  CASE WHEN contains(name, ',') THEN trim(string_split(name, ',')[1])
    ELSE trim(regexp_extract(name, '(?i)(^|\\s)((?:(?:{_PARTICLES})\\s+)*\\S+)$', 2)) END AS lastname FROM names""")
def name_parts(spark, sf_dir):
    names = collection(spark, sf_dir).select(F.explode(text.split_values(F.col("creator"))).alias("name")).distinct()
    return names.withColumn("p", parse_name(F.col("name"))).select("name", "p.firstname", "p.lastname")


@query("loaded_cells", f"WITH {COLLECTION} SELECT * FROM collection")
def loaded_cells(spark, sf_dir):
    return collection(spark, sf_dir)


@query("term_normalization", """
SELECT doc_id, regexp_replace(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')), '^\\s+', '') AS term FROM documents""")
def term_normalization(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.normalize_term(F.col("text")).alias("term"))


@query("confidence_values", f"""WITH {inputs.cte('wide_ne')}
SELECT named_entity_1_gnd_konfidenz AS raw, cast(replace(named_entity_1_gnd_konfidenz, '%', '') AS DOUBLE) / 100.0 AS confidence, count(*) AS n FROM wide_ne GROUP BY ALL
UNION ALL SELECT named_entity_2_gnd_konfidenz, cast(named_entity_2_gnd_konfidenz AS DOUBLE), count(*) FROM wide_ne GROUP BY ALL""")
def confidence_values(spark, sf_dir):
    w = inputs.derive(spark, sf_dir, "wide_ne")
    raw = w.select(F.explode(F.array("named_entity_1_gnd_konfidenz", "named_entity_2_gnd_konfidenz")).alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).withColumn("confidence", text.parse_confidence(F.col("raw")))


@query("json_answers", """
SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 <> 2 AS is_structure FROM
  (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{}' ELSE props END AS props FROM events)""")
def json_answers(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit(" ﻿"), "props")
    ).otherwise(F.lit('"scalar"'))
    v = text.parse_json(raw)
    e = inputs.table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("is_structure"))


@query("safe_numbers", """
SELECT part.p_partkey, CASE WHEN length(p_name) > 8 THEN p_name[1:7] || '…' ELSE p_name END AS short_name,
  coalesce(try_cast(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE cast(p_size AS VARCHAR) || '.9' END AS DOUBLE), 0.0) AS as_float,
  cast(floor(coalesce(try_cast(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE cast(p_size AS VARCHAR) || '.9' END AS DOUBLE), 0.0)) AS BIGINT) AS as_int FROM part""")
def safe_numbers(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".9")))
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey", text.truncate(F.col("p_name"), 8).alias("short_name"), text.safe_float(raw).alias("as_float"), text.safe_int(raw).alias("as_int")
    )


@query("multi_value_rows", f"""WITH {COLLECTION}, s AS (
SELECT record_id, title, unnest(CASE WHEN len(list_filter(list_transform(string_split(subject, ';'), lambda x: trim(x)), lambda x: x <> '')) > 0 THEN list_filter(list_transform(string_split(subject, ';'), lambda x: trim(x)), lambda x: x <> '') ELSE [NULL] END) AS subject,
  CASE WHEN place IS NULL THEN [NULL] ELSE list_filter(list_transform(string_split(place, ';'), lambda x: trim(x)), lambda x: x <> '') END AS ps FROM collection)
SELECT record_id, title, subject, unnest(ps) AS place FROM s""")
def multi_value_rows(spark, sf_dir):
    from ..operators.reshape import split_multivalued

    return split_multivalued(collection(spark, sf_dir).select("record_id", "title", "subject", "place"), ["subject", "place"])


@query("prompt_fingerprints", """
SELECT sha256(t) AS sha256, length(t) AS length, CASE WHEN length(t) > 240 THEN t[1:240] || '…' ELSE t END AS preview, o AS is_override, count(*) AS n FROM (
SELECT CASE WHEN trim(CASE WHEN conv_id % 3 = 0 THEN '  ' ELSE text END) <> '' THEN text ELSE 'Standard' END AS t, conv_id % 3 <> 0 AND trim(text) <> '' AS o FROM conversations) GROUP BY ALL""")
def prompt_fingerprints(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "conversations")
    f = text.fingerprint(F.lit("Standard"), F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.col("text")))
    return c.select(f.alias("f")).groupBy("f.sha256", "f.length", "f.preview", "f.is_override").agg(F.count("*").alias("n"))


@query("file_names", """
SELECT page_id, regexp_replace(url, '[^\\w\\-]', '_', 'g') AS safe_name, lower(regexp_extract(url, '[^/\\\\]*$')) AS base_name FROM pages""")
def file_names(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", text.safe_file_name(F.col("url")).alias("safe_name"), text.base_name(F.col("url")).alias("base_name")
    )


@query("record_context", f"""WITH {COLLECTION} SELECT record_id,
  (CASE WHEN title IS NULL THEN 0 ELSE 1 END) + (CASE WHEN creator IS NULL THEN 0 ELSE 1 END) + (CASE WHEN place IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN subject IS NULL THEN 0 ELSE 1 END) + (CASE WHEN date_text IS NULL THEN 0 ELSE 1 END) AS others,
  concat_ws('; ', record_id, title, creator, place, subject, date_text, note)[1:500] AS row_text FROM collection WHERE note IS NOT NULL""")
def record_context(spark, sf_dir):
    from ..operators.reshape import record_context as context, row_text

    df = collection(spark, sf_dir).where(F.col("note").isNotNull())
    ctx = context(["title", "creator", "place", "subject", "date_text", "note"], skip="note")
    return df.select("record_id", F.size(ctx).alias("others"), row_text(df.columns, size=500).alias("row_text"))


@query("code_labels", f"""WITH {inputs.cte('mentions')} SELECT entity_type,
  MAP {{'PER': 'person', 'ORG': 'institution', 'LOC': 'place', 'GPE': 'place', 'CON': 'concept', 'DAT': 'other', 'TOP': 'concept'}}[entity_type] AS dictionary_type,
  coalesce(MAP {{'PER': 'Person', 'ORG': 'Organization', 'LOC': 'Place', 'GPE': 'Place', 'DAT': 'DateTime', 'CON': 'DefinedTerm'}}[entity_type], 'Thing') AS schema_type,
  lower(trim(text)) || '||' || entity_type AS dedup_key, count(*) AS n FROM mentions GROUP BY ALL""")
def code_labels(spark, sf_dir):
    m = inputs.derive(spark, sf_dir, "mentions")
    key = F.concat_ws("||", F.lower(text.strip(F.col("text"))), "entity_type")
    return m.groupBy(
        "entity_type", codes.mapped(F.col("entity_type"), codes.ENTITY_TO_DICTIONARY, "other").alias("dictionary_type"),
        codes.mapped(F.col("entity_type"), codes.ENTITY_TO_SCHEMA, "Thing").alias("schema_type"), key.alias("dedup_key"),
    ).agg(F.count("*").alias("n"))


# ---- term scans -------------------------------------------------------------

TERM_LIST = [
    ("Kutsche", "Wagen", "fahrzeug", ""), ("pferd", "", "tier", ""), ("alte Mühle", "", "bau", "mehrere Wörter"),
    ("St. Gallen", "", "ort", "mit Punkt"), ("tal", "", "natur", ""), ("rosa", "", "name", ""), ("KUTSCHE", "Kutschwagen", "fahrzeug", "ersetzt"),
]


def term_list(spark):
    rows = [(*t, i) for i, t in enumerate(TERM_LIST)]
    return spark.createDataFrame(rows, "term string, replacement string, category string, note string, ord int")


_KEYS = "(SELECT unnest(['kutsche', 'pferd', 'alte mühle', 'st. gallen', 'tal', 'rosa']) AS key, unnest(['KUTSCHE', 'pferd', 'alte Mühle', 'St. Gallen', 'tal', 'rosa']) AS term)"
_B = "[\\s,;.!?\"''()\\[\\]]"


@query("term_scan_words", f"""WITH {CELLS} SELECT record_id, "column", term FROM cells, {_KEYS}
WHERE dataset = 'collection' AND regexp_matches(lower(value), '(^|{_B})' || replace(key, '.', '\\.') || '($|{_B})')""")
def term_scan_words(spark, sf_dir):
    c = profile.cells(collection(spark, sf_dir), "record_id")
    return terms.scan_terms(c, term_list(spark)).select("record_id", "column", "term")


@query("term_scan_substrings", f"""WITH {CELLS} SELECT record_id, "column", term FROM cells, {_KEYS}
WHERE dataset = 'collection' AND contains(lower(value), key)""")
def term_scan_substrings(spark, sf_dir):
    c = profile.cells(collection(spark, sf_dir), "record_id")
    return terms.scan_terms(c, term_list(spark), whole_word=False).select("record_id", "column", "term")


@query("term_scan_case_sensitive", f"""WITH {CELLS} SELECT term, category, count(*) AS matches FROM cells,
(SELECT unnest(['Kutsche', 'pferd', 'alte Mühle', 'St. Gallen', 'tal', 'rosa', 'KUTSCHE']) AS term, unnest(['fahrzeug', 'tier', 'bau', 'ort', 'natur', 'name', 'fahrzeug']) AS category)
WHERE dataset = 'collection' AND regexp_matches(value, '(^|{_B})' || replace(term, '.', '\\.') || '($|{_B})') GROUP BY ALL""")
def term_scan_case_sensitive(spark, sf_dir):
    c = profile.cells(collection(spark, sf_dir), "record_id")
    return terms.match_counts(terms.scan_terms(c, term_list(spark), case_sensitive=True))


@query("term_scan_documents", f"""SELECT doc_id AS record_id, word AS term FROM documents, (SELECT unnest(['und', 'der', 'the', 'with', 'license', 'mit']) AS word)
WHERE regexp_matches(lower(text), '(^|{_B})' || word || '($|{_B})')""")
def term_scan_documents(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.lit("text").alias("column"), F.col("text").alias("value"))
    words = spark.createDataFrame(
        [(w, "", "", "", i) for i, w in enumerate(["und", "der", "the", "with", "license", "mit"])],
        "term string, replacement string, category string, note string, ord int",
    )
    return terms.scan_terms(d, words).select("record_id", "term")


_PHRASES = """pairs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,} [a-z]{3,}')) AS term FROM benchmark)"""


def _phrases(spark, sf_dir):
    """Hundreds of terms of two words each, from the benchmark."""
    b = inputs.table(spark, sf_dir, "benchmark")
    found = b.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,} [a-z]{3,}"), F.lit(0))).alias("term")).distinct()
    blank = F.lit("")
    return found.select("term", blank.alias("replacement"), blank.alias("category"), blank.alias("note"), F.crc32(F.col("term").cast("binary")).alias("ord"))


def _texts(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.lit("text").alias("column"), F.col("text").alias("value"))


@query("term_scan_phrases", f"""WITH {_PHRASES} SELECT doc_id AS record_id, term FROM documents, pairs
WHERE contains(lower(text), term) AND regexp_matches(lower(text), '(^|{_B})' || term || '($|{_B})')""")
def term_scan_phrases(spark, sf_dir):
    return terms.scan_terms(_texts(spark, sf_dir), _phrases(spark, sf_dir), inline=0).select("record_id", "term")


@query("term_scan_phrase_parts", f"""WITH {_PHRASES} SELECT doc_id AS record_id, term FROM documents, pairs WHERE contains(lower(text), term)""")
def term_scan_phrase_parts(spark, sf_dir):
    return terms.scan_terms(_texts(spark, sf_dir), _phrases(spark, sf_dir), whole_word=False, inline=0).select("record_id", "term")


@query("term_scan_long_list", """WITH w AS (SELECT DISTINCT trim(lower(unnest(string_split_regex(text, '[\\s.,]+')))) AS term FROM benchmark),
t AS (SELECT term FROM w WHERE length(term) >= 3) SELECT doc_id AS record_id, term FROM documents, t WHERE contains(lower(text), term)""")
def term_scan_long_list(spark, sf_dir):
    """Every word of the benchmark as a substring of every document."""
    words = inputs.table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[\s.,]+")).alias("term")).where(F.length("term") >= 3).distinct()
    listed = words.select("term", F.lit("").alias("replacement"), F.lit("").alias("category"), F.lit("").alias("note"), F.lit(0).alias("ord"))
    return terms.scan_terms(_texts(spark, sf_dir), listed, whole_word=False, inline=0).select("record_id", "term")


@query("term_scan_transcriptions", f"""WITH {inputs.cte('images')} SELECT coalesce(nullif(record_id, ''), image_id) AS record_id, '[OCR] ' || filename AS "column", 'KUTSCHE' AS term
FROM images WHERE contains(json_extract_string(result, '$.transcription'), 'Kutsche')""")
def term_scan_transcriptions(spark, sf_dir):
    return terms.scan_terms(terms.ocr_cells(inputs.derive(spark, sf_dir, "images")), term_list(spark)).select("record_id", "column", "term")


@query("term_list_merge", """WITH new AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'PFERD' ELSE 'Wort ' || cast(o_custkey % 40 AS VARCHAR) END AS term FROM orders)
SELECT unnest(['Kutsche', 'pferd', 'alte Mühle', 'St. Gallen', 'tal', 'rosa', 'KUTSCHE']) AS term
UNION ALL SELECT min_by(term, ord) FROM new WHERE lower(term) <> 'pferd' GROUP BY lower(term)""")
def term_list_merge(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    new = o.select(
        F.when(F.col("o_orderkey") % 4 == 0, "PFERD").otherwise(F.concat(F.lit("Wort "), (F.col("o_custkey") % 40).cast("string"))).alias("term"),
        F.lit("").alias("replacement"), F.lit("").alias("category"), F.lit("").alias("note"), F.col("o_orderkey").cast("int").alias("ord"),
    )
    return terms.add_new_terms(term_list(spark), new).select("term")
