"""Model-backed steps with deterministic stand-ins for the model."""
from __future__ import annotations

import json
import zlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import inputs
from ..functions.text import base_name
from ..operators import batch, dictionary, entities, model_checks as mc, profile, report
from ..session import scratch_path
from ..sources import images as image_files
from ..streaming import incremental
from .dates_text import DATES_SQL
from .quality import COLLECTION, collection
from .registry import query

_I = inputs.cte("images")


def tagger(items: list[dict]) -> list[str]:
    """Calls every word with a capital letter an entity; fails on a marked item."""
    out = []
    for item in items:
        words = [w.strip(".,;:()\"") for w in item["text"].split()]
        if "Kutschen" in words:
            raise RuntimeError("model refused")
        if item["text"].startswith("Das"):
            out.append("no json")
            continue
        found = [{"text": w, "type": "PERSON" if len(w) % 2 else "LOC", "confidence": round(len(w) % 10 / 10, 1)} for w in words if w[:1].isupper()]
        out.append("```json\n" + json.dumps({"entities": found}, ensure_ascii=False) + "\n```")
    return out


def judge(items: list[dict]) -> list[str]:
    """Cell judge: mixed separators are misplaced, short values are generic."""
    out = []
    for item in items:
        v = item["value"]
        issue = "semantic_misplacement" if ";" in v and "," in v else "generic" if len(v) < 5 else "likely_correct"
        out.append(json.dumps({"issue_type": issue, "severity": "warning" if issue == "semantic_misplacement" else "ok", "confidence": 0.9, "reasoning": issue}))
    return out


def dater(items: list[dict]) -> list[str]:
    return [json.dumps({"original": i["text"], "edtf": "19XX" if i["ord"] % 2 else "", "confidence": 0.4, "note": "model"}) for i in items]


_NOTES = COLLECTION + ", n AS (SELECT record_id, note FROM collection WHERE note IS NOT NULL)"


@query("model_batch_report", f"""WITH {_NOTES} SELECT count(*) AS total, count(*) FILTER (NOT contains(note, 'Kutschen')) AS succeeded, count(*) FILTER (contains(note, 'Kutschen')) AS failed,
  count(*) FILTER (starts_with(note, 'Das')) AS parse_failed, count(*) FILTER (NOT contains(note, 'Kutschen')) / count(*) AS success_rate FROM n""")
def model_batch_report(spark, sf_dir):
    items = mc.text_items(collection(spark, sf_dir), ["note"], "record_id")
    return batch.batch_report(batch.answer_table(items, tagger)).drop("avg_duration")


@query("model_completion", f"""WITH {_NOTES}, s AS (SELECT count(*) AS total_records, (SELECT count(DISTINCT record_id) FROM n WHERE starts_with(note, 'Kutsche')) AS succeeded, count(*) FILTER (contains(note, 'Kutschen')) AS llm_failed,
  count(*) FILTER (starts_with(note, 'Das')) AS parse_failed, cast(0 AS BIGINT) AS empty_result FROM n)
SELECT *, round(succeeded / total_records, 4) AS completion_rate, cast(round_even(succeeded / total_records * 100, 0) AS INTEGER) AS completion_percentage FROM s""")
def model_completion(spark, sf_dir):
    found, parsed = mc.extract_mentions(mc.text_items(collection(spark, sf_dir), ["note"], "record_id"), tagger)
    return batch.completion_summary(parsed, found)


@query("model_parse_failures", f"""WITH {_NOTES} SELECT record_id, 'no json' AS raw_response_preview, 'JSON parse failed' AS error_message FROM n WHERE starts_with(note, 'Das')""")
def model_parse_failures(spark, sf_dir):
    return batch.parse_failures(batch.answer_table(mc.text_items(collection(spark, sf_dir), ["note"], "record_id"), tagger))


_WORDS = COLLECTION + """, w AS (SELECT record_id, 'title' AS source_column, trim(unnest(string_split(title, ' ')), '.,;:()"') AS text FROM collection WHERE title IS NOT NULL)"""


@query("model_mentions", f"""WITH {_WORDS} SELECT record_id, source_column, text, CASE WHEN length(text) % 2 = 1 THEN 'PER' ELSE 'LOC' END AS entity_type, length(text) % 10 / 10 AS confidence FROM w WHERE regexp_matches(text, '^\\p{{Lu}}')""")
def model_mentions(spark, sf_dir):
    items = mc.text_items(collection(spark, sf_dir), ["title"], "record_id")
    return mc.extract_mentions(items, tagger)[0].select("record_id", "source_column", "text", "entity_type", "confidence")


@query("ocr_dictionary", f"""WITH {inputs.cte('images')}, w AS (SELECT coalesce(nullif(record_id, ''), image_id) AS record_id, unnest(string_split(json_extract_string(result, '$.transcription'), ' ')) AS term FROM images WHERE review_status = 'accepted'),
c AS (SELECT * FROM w WHERE regexp_matches(term, '^\\p{{Lu}}') AND length(term) % 2 = 1)
SELECT lower(term) AS key, min(term) AS term, 'person' AS entity_type, 'ocr' AS source, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM c GROUP BY 1""")
def ocr_dictionary(spark, sf_dir):
    """Names in accepted transcriptions, reviewed as a whole, as dictionary entries with their records."""
    found, _ = mc.ocr_mentions(inputs.derive(spark, sf_dir, "images"), tagger, types=("PER",))
    made = dictionary.from_mentions(found.withColumn("status", F.lit("accepted")), source="ocr")
    counts = made.links.groupBy("key").agg(F.count("*").alias("records"))
    return made.entries.join(counts, "key").select("key", "term", "entity_type", "source", "occurrences", "records")


@query("hybrid_mentions", f"""WITH {_WORDS}, a AS (SELECT DISTINCT record_id, 'Ansicht' AS text, 'PER' AS entity_type FROM collection WHERE starts_with(title, 'Ansicht')),
b AS (SELECT DISTINCT record_id, text, CASE WHEN length(text) % 2 = 1 THEN 'PER' ELSE 'LOC' END AS entity_type FROM w WHERE regexp_matches(text, '^\\p{{Lu}}'))
SELECT record_id, text, entity_type, CASE WHEN a.text IS NULL THEN 'llm' WHEN b.text IS NULL THEN 'gazetteer' ELSE 'hybrid' END AS source FROM a FULL JOIN b USING (record_id, text, entity_type)""")
def hybrid_mentions(spark, sf_dir):
    df = collection(spark, sf_dir)
    known = spark.createDataFrame([("Ansicht", "PER", 0)], "term string, entity_type string, ord int")
    return mc.extract_hybrid(df, ["title"], known, tagger).select("record_id", "text", "entity_type", "source")


_HYBRID = DATES_SQL + """, hyb AS (SELECT record_id, ord, original, CASE WHEN edtf IS NOT NULL THEN edtf WHEN ord % 2 = 1 THEN '19XX' ELSE '' END AS edtf, CASE WHEN edtf IS NULL THEN 'llm' ELSE 'rule' END AS method FROM edtf)"""


@query("hybrid_dates", f"WITH {_HYBRID} SELECT record_id, ord, edtf, method FROM hyb")
def hybrid_dates(spark, sf_dir):
    return mc.hybrid_dates(inputs.derive(spark, sf_dir, "date_texts"), dater).select("record_id", "ord", "edtf", "method")


@query("dates_without_model", f"WITH {DATES_SQL} SELECT ord, coalesce(edtf, '') AS edtf, 'rule' AS method, edtf IS NOT NULL AS valid FROM edtf")
def dates_without_model(spark, sf_dir):
    return mc.hybrid_dates(inputs.derive(spark, sf_dir, "date_texts")).select("ord", "edtf", "method", "valid")


_JUDGED = COLLECTION + """, c AS (SELECT record_id, 'place' AS "column", place AS value FROM collection UNION ALL SELECT record_id, 'subject', subject FROM collection),
j AS (SELECT *, CASE WHEN contains(value, ';') AND contains(value, ',') THEN 'semantic_misplacement' WHEN length(value) < 5 THEN 'generic' ELSE 'likely_correct' END AS issue_type FROM c WHERE value IS NOT NULL)"""


def _judged(spark, sf_dir):
    items = mc.cell_items(collection(spark, sf_dir), "record_id", ["place", "subject"])
    return mc.cell_findings(batch.answer_table(items, judge))


@query("model_cell_findings", f"""WITH {_JUDGED} SELECT record_id, "column", value, CASE issue_type WHEN 'generic' THEN 'low_information_value' ELSE 'field_misuse' END AS category,
  CASE issue_type WHEN 'generic' THEN 'info' ELSE 'warning' END AS severity FROM j WHERE issue_type <> 'likely_correct'""")
def model_cell_findings(spark, sf_dir):
    return _judged(spark, sf_dir).select("record_id", "column", "value", "category", "severity")


@query("model_issue_clusters", f"""WITH {_JUDGED}, f AS (SELECT record_id, "column", CASE issue_type WHEN 'generic' THEN 'low_information_value' ELSE 'field_misuse' END AS category, CASE issue_type WHEN 'generic' THEN 'info' ELSE 'warning' END AS severity FROM j WHERE issue_type <> 'likely_correct'),
g AS (SELECT category, any_value(severity) AS severity, array_to_string(list_sort(list(DISTINCT "column")), ',') AS affected_columns, count(DISTINCT record_id) AS affected_records FROM f GROUP BY 1)
SELECT 'cluster_' || lpad(cast(row_number() OVER (ORDER BY severity = 'info', category) - 1 AS VARCHAR), 3, '0') || '_' || category AS cluster_id, severity, affected_columns, affected_records FROM g""")
def model_issue_clusters(spark, sf_dir):
    c = report.issue_clusters(mc.as_findings(_judged(spark, sf_dir), "collection"))
    return c.select("cluster_id", "severity", F.concat_ws(",", "affected_columns").alias("affected_columns"), "affected_records")


@query("model_reports_by_record", f"""WITH {_JUDGED} SELECT record_id, CASE WHEN bool_or(issue_type <> 'generic') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n_issues, bool_or(issue_type <> 'generic') AS review_required
FROM j WHERE issue_type <> 'likely_correct' GROUP BY 1""")
def model_reports_by_record(spark, sf_dir):
    r = report.record_reports(mc.as_findings(_judged(spark, sf_dir), "collection"))
    return r.select("record_id", "severity", F.size("issues").cast("long").alias("n_issues"), "review_required")


def purity(items: list[dict]) -> list[str]:
    return [json.dumps({"field_purity_score": 100.0 - len(json.loads(i["sample_values"])), "confidence": 0.8, "review_required": i["non_empty_count"] < i["total_count"]}) for i in items]


_COLS = COLLECTION + """, c AS (SELECT 'place' AS "column", place AS value FROM collection UNION ALL SELECT 'subject', subject FROM collection UNION ALL SELECT 'creator', creator FROM collection)"""


@query("model_column_reports", f"""WITH {_COLS} SELECT "column", 100.0::DOUBLE - least(50, count(DISTINCT value)) AS field_purity_score, count(value) < count(*) AS review_required FROM c GROUP BY 1""")
def model_column_reports(spark, sf_dir):
    items = mc.column_items(collection(spark, sf_dir), ["place", "subject", "creator"])
    return mc.column_reports(batch.answer_table(items, purity)).select("column", "field_purity_score", "review_required")


@query("model_issue_summary", f"""WITH {_JUDGED}, f AS (SELECT * FROM j WHERE issue_type <> 'likely_correct') SELECT 'issue_type' AS kind, issue_type AS name, count(*)::DOUBLE AS n FROM f GROUP BY 2
UNION ALL SELECT 'column', "column", count(*) FROM f GROUP BY 2 UNION ALL SELECT 'purity', "column", 100.0 - least(50, count(DISTINCT value)) FROM c GROUP BY 2""")
def model_issue_summary(spark, sf_dir):
    reports = mc.column_reports(batch.answer_table(mc.column_items(collection(spark, sf_dir), ["place", "subject"]), purity))
    return mc.issue_summary(_judged(spark, sf_dir), reports)


def coherence(items: list[dict]) -> list[str]:
    out = []
    for item in items:
        fields = json.loads(item["fields"])
        bad = "title" not in fields
        out.append(json.dumps({"severity": "warning" if bad else "ok", "conflicts": [{"description": "kein Titel"}] if bad else [], "overall_confidence": 0.7, "review_required": bad}))
    return out


@query("model_record_reports", f"""WITH {COLLECTION} SELECT record_id, CASE WHEN title IS NULL THEN 'warning' ELSE 'info' END AS severity, CASE WHEN title IS NULL THEN 1 ELSE 0 END AS n_issues FROM collection
WHERE title IS NOT NULL OR place IS NOT NULL""")
def model_record_reports(spark, sf_dir):
    items = mc.record_items(collection(spark, sf_dir), "record_id", ["title", "place"])
    return mc.record_reports(batch.answer_table(items, coherence)).select("record_id", "severity", F.size("issues").alias("n_issues"))


def scanner(items: list[dict]) -> list[str]:
    return [json.dumps({"problematic_terms": [{"term": "Kutsche", "reason": "alt", "severity": "low", "suggestion": "Wagen"}] if "Kutsche" in i["text"] else [], "clean": True}) for i in items]


@query("model_problem_terms", f"""WITH {COLLECTION}, s AS (SELECT * FROM collection ORDER BY md5('42:' || record_id), record_id LIMIT 100000000)
SELECT record_id, 'Kutsche' AS term, 'low' AS severity FROM s WHERE contains(note, 'Kutsche')""")
def model_problem_terms(spark, sf_dir):
    items = mc.term_items(collection(spark, sf_dir), "record_id")
    return mc.problem_terms(batch.answer_table(items, scanner)).select("record_id", "term", "severity")


def classifier(items: list[dict]) -> list[str]:
    out = []
    for item in items:
        parts = [p.strip() for p in item["text"].split(";")]
        out.append(json.dumps({"unclassified": [p for p in parts if p[:1].islower()], "classifications": [{"term": p, "confidence": 0.3 if len(p) < 5 else 0.9} for p in parts]}))
    return out


_PARTS = COLLECTION + ", p AS (SELECT record_id, trim(unnest(string_split(subject, ';'))) AS term FROM collection WHERE subject IS NOT NULL)"


@query("subject_classification", f"""WITH {_PARTS} SELECT 'unclassified' AS kind, record_id, term FROM p WHERE regexp_matches(term, '^\\p{{Ll}}') UNION ALL SELECT 'doubtful', record_id, term FROM p WHERE length(term) < 5""")
def subject_classification(spark, sf_dir):
    parsed = batch.answer_table(mc.text_items(collection(spark, sf_dir), ["subject"], "record_id"), classifier)
    loose, doubtful = mc.subject_terms(parsed)
    return loose.withColumn("kind", F.lit("unclassified")).unionByName(doubtful.withColumn("kind", F.lit("doubtful")))


@query("subject_findings", f"""WITH {_PARTS} SELECT 'warning' AS severity, (SELECT count(*) FROM p WHERE regexp_matches(term, '^\\p{{Ll}}')) || ' terms could not be classified' AS message
UNION ALL SELECT 'info', 'Semantic classification: ' || count(subject) || '/' || count(subject) || ' records' FROM collection""")
def subject_findings(spark, sf_dir):
    parsed = batch.answer_table(mc.text_items(collection(spark, sf_dir), ["subject"], "record_id"), classifier)
    return mc.subject_findings(parsed, "subject").select("severity", "message")


@query("transcription_mentions", f"""WITH {_I} SELECT coalesce(nullif(record_id, ''), image_id) AS record_id, '[OCR] ' || filename AS source_column, unnest(['Kutsche', 'Ort']) AS text FROM images WHERE review_status = 'accepted'""")
def transcription_mentions(spark, sf_dir):
    items = mc.transcription_items(inputs.derive(spark, sf_dir, "images"))
    return mc.extract_mentions(items, tagger)[0].select("record_id", "source_column", "text")


@query("page_mentions", """WITH pages AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations WHERE turn % 3 <> 2 AND text IS NOT NULL AND NOT starts_with(text, 'Das')),
w AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\\s+')), '.,;:()"') AS text FROM pages)
SELECT DISTINCT cast(doc_id AS VARCHAR) AS doc_id, text FROM w WHERE regexp_matches(text, '^\\p{Lu}')""")
def page_mentions(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "conversations")
    marked = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("[… leer] "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), marked.alias("text"))
    return mc.page_mentions(pages, tagger)[0].select("doc_id", "text")


@query("model_rerun_skips", f"""WITH {_NOTES}, k AS (SELECT count(*) AS n, count(*) FILTER (contains(note, 'Kutschen')) AS failed FROM n)
SELECT 'first' AS run, n AS asked FROM k UNION ALL SELECT 'second', failed FROM k""")
def model_rerun_skips(spark, sf_dir):
    """A second run asks again for the items that failed, and for no others."""
    path = scratch_path(spark, "answers")
    items = mc.text_items(collection(spark, sf_dir), ["note"], "record_id")
    once = batch.answer_table(items, tagger, "names", path).count()
    batch.answer_table(items, tagger, "names", path)
    total = _stored(spark, path).agg(F.count("*").alias("n"))
    return total.select(F.stack(F.lit(2), F.lit("first"), F.lit(once).cast("long"), F.lit("second"), F.col("n") - F.lit(once)).alias("run", "asked"))


def _stored(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/answers")


def _fatal(items: list[dict]) -> list[str]:
    if any(zlib.crc32(i["record_id"].encode()) % 997 == 3 for i in items):
        raise SystemExit(1)  # the worker is gone, not the item
    return ["{}"] * len(items)


@query("model_resumed_steps", """SELECT count(*) AS items, count(*) AS answers, count(DISTINCT o_orderkey) AS keys, true AS rest_only FROM orders""")
def model_resumed_steps(spark, sf_dir):
    """A run whose workers die keeps its finished steps; the next asks for the rest only."""
    path = scratch_path(spark, "answers")
    items = inputs.table(spark, sf_dir, "orders").select(F.concat(F.lit("rec_"), "o_orderkey").alias("record_id"), "o_orderpriority")
    try:
        batch.answer_table(items, _fatal, "state", path, step=100)
    except StreamingQueryException:
        pass
    keyed = batch.with_item_keys(items, "state")
    kept = batch.stored_answers(keyed, path).count()
    found = batch.answer_table(items, lambda rows: ["{}"] * len(rows), "state", path, step=1000)
    return found.agg(F.count("*").alias("answers"), F.countDistinct("item_key").alias("keys")).select(
        F.lit(items.count()).alias("items"), "answers", "keys", (F.col("answers") - kept == F.lit(items.count() - kept)).alias("rest_only"))


@query("page_labels", f"""WITH {_I} SELECT CASE WHEN analyzed IS FALSE THEN 'error' WHEN coalesce(try_cast(json_extract_string(result, '$.confidence') AS DOUBLE), 0) >= 0.7 THEN 'high' ELSE 'low' END AS label, count(*) AS n FROM images GROUP BY 1""")
def page_labels(spark, sf_dir):
    from .export import image_confidence

    i = inputs.derive(spark, sf_dir, "images")
    return i.groupBy(mc.page_label(image_confidence(), F.when(~F.col("analyzed"), "failed")).alias("label")).agg(F.count("*").alias("n"))


@query("field_meanings", """SELECT unnest(['place', 'creator', 'date_text', 'x']) AS "column", unnest(['Geografischer Ort', 'Person oder Organisation, die das Objekt erschaffen hat', 'Datum oder Datumsbereich', '']) AS field_semantics, (SELECT count(*) FROM orders) AS n""")
def field_meanings(spark, sf_dir):
    columns = ["place", "creator", "date_text", "x"]
    rows = collection(spark, sf_dir).withColumn("x", F.lit("y"))
    return mc.with_semantics(profile.cells(rows, None, columns), columns).groupBy("column", "field_semantics").agg(F.count("*").alias("n"))


# ---- images as files --------------------------------------------------------

def _write_images(spark, sf_dir):
    """One small PNG or JPEG header per web page, written by the tasks."""
    import os
    import struct

    folder = scratch_path(spark, "images")

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            w, h = 100 + r["page_id"] % 400, 50 + r["page_id"] % 300
            if r["page_id"] % 2:
                data, ext = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x00" * 12, "jpg"
            else:
                data, ext = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h), "png"
            with open(os.path.join(folder, f"page_{r['page_id']}.{ext}"), "wb") as fh:
                fh.write(data)

    inputs.table(spark, sf_dir, "pages").select("page_id").foreachPartition(write)
    return folder


@query("image_scan", """SELECT 'page_' || page_id || CASE WHEN page_id % 2 = 1 THEN '.jpg' ELSE '.png' END AS filename, CASE WHEN page_id % 2 = 1 THEN 'image/jpeg' ELSE 'image/png' END AS mime_type,
  cast(100 + page_id % 400 AS INTEGER) AS width, cast(50 + page_id % 300 AS INTEGER) AS height, cast(CASE WHEN page_id % 2 = 1 THEN 29 ELSE 24 END AS BIGINT) AS size_bytes,
  sha256(unhex(hex)) AS hash_sha256, to_base64(unhex(hex)) AS base64_data, 0 AS n_errors FROM (SELECT page_id, CASE WHEN page_id % 2 = 1
    THEN 'FFD8FFE000046162FFC0001108' || right('0000' || hex(50 + page_id % 300), 4) || right('0000' || hex(100 + page_id % 400), 4) || repeat('00', 12)
    ELSE '89504E470D0A1A0A0000000D49484452' || right('00000000' || hex(100 + page_id % 400), 8) || right('00000000' || hex(50 + page_id % 300), 8) END AS hex FROM pages)""")
def image_scan(spark, sf_dir):
    rows = image_files.scan_images(spark, _write_images(spark, sf_dir), with_content=True)
    return rows.select("filename", "mime_type", "width", "height", "size_bytes", "hash_sha256", "base64_data", F.size("errors").alias("n_errors"))


def describer(items: list[dict]) -> list[str]:
    return [json.dumps({"description": f"{len(i['content'])} Bytes", "confidence": 0.6}) for i in items]


@query("image_descriptions", """SELECT 'page_' || page_id || CASE WHEN page_id % 2 = 1 THEN '.jpg' ELSE '.png' END AS filename, CASE WHEN page_id % 2 = 1 THEN '29 Bytes' ELSE '24 Bytes' END AS description, true AS analyzed FROM pages""")
def image_descriptions(spark, sf_dir):
    files = spark.read.format("binaryFile").load(_write_images(spark, sf_dir)).select(base_name(F.col("path")).alias("filename"), "content")
    return mc.image_results(files, describer).select("filename", F.get_json_object("result", "$.description").alias("description"), "analyzed")


# ---- incremental run --------------------------------------------------------

#: Batches of the derived input, and the rows of one of its files.
BATCHES, FILE_ROWS = 3, 100_000


def _dates_run(spark, sf_dir):
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "run")
    rows = inputs.table(spark, sf_dir, "orders").count()
    files = max(2, rows // (BATCHES * FILE_ROWS))  # files of a size, more for more rows
    inputs.derive(spark, sf_dir, "date_texts").repartition(BATCHES * files, "ord").write.parquet(source)
    record = incremental.run_incremental(
        spark, source, "record_id string, text string, ord long", lambda batch_df: mc.hybrid_dates(batch_df), out, files_per_batch=files, task="edtf"
    )
    return record, out


@query("incremental_dates", f"WITH {DATES_SQL} SELECT ord, coalesce(edtf, '') AS edtf FROM edtf")
def incremental_dates(spark, sf_dir):
    out = _dates_run(spark, sf_dir)[1]
    return incremental.results(spark, out).select("ord", "edtf")


@query("incremental_run_log", "SELECT 'edtf' AS task, cast(1 AS BIGINT) AS runs, count(*) AS rows, cast(0 AS BIGINT) AS errors, cast(3 AS BIGINT) AS chunks FROM orders")
def incremental_run_log(spark, sf_dir):
    return batch.run_log(_dates_run(spark, sf_dir)[0])
