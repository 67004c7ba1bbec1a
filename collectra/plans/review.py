"""Review queue, decisions and corrections."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs
from ..operators import entities, filters, remediation, report, review
from ..session import scratch_path
from ..sinks import tables
from ..sources import workspace
from . import quality
from .authority import mentions
from .registry import query

_F = quality.FINDINGS + quality._LISTED + quality._CLUSTERS
_I = inputs.cte("images")
_M = inputs.cte("mentions")
_D = inputs.cte("decisions")


def _queue(spark, sf_dir):
    f = quality._findings(spark, sf_dir)
    clusters = report.issue_clusters(f)
    return review.build_queue(report.cell_findings(f), report.record_reports(f), clusters, "collection"), clusters


_R = quality._RANK
_ITEMS = _F + f""", items AS (
SELECT 'cell' AS level, ids AS record_id, "column", category, severity FROM findings WHERE "column" <> '' AND ids <> '' AND NOT contains(ids, ',')
UNION ALL SELECT 'record', record_id, NULL, 'cross_field_conflict', ['critical', 'warning', 'info'][min({_R}) + 1] FROM listed GROUP BY record_id HAVING min({_R}) < 2
UNION ALL SELECT 'cluster', NULL, nullif(string_split(coalesce(affected_columns, ''), ',')[1], ''), category, severity FROM numbered WHERE severity <> 'info')"""


@query("review_queue", f"""WITH {_ITEMS} SELECT record_id, "column", category, severity, 'pending' AS status FROM items""")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir)[0].select("record_id", "column", "category", "severity", "status")


@query("review_queue_summary", f"""WITH {_ITEMS} SELECT 'total' AS facet, 'all' AS value, count(*) AS n FROM items
UNION ALL SELECT 'status', 'pending', count(*) FROM items UNION ALL SELECT 'severity', severity, count(*) FROM items GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM items GROUP BY category""")
def review_queue_summary(spark, sf_dir):
    return review.queue_summary(_queue(spark, sf_dir)[0])


@query("work_packages", f"""WITH {_F} SELECT category AS issue_family, severity AS priority, affected_records AS estimated_records,
  CASE WHEN category IN ('missing_values', 'encoding_issues', 'format_inconsistency', 'duplicate_records') THEN 'high' WHEN category IN ('term_variants', 'gnd_match_missing') THEN 'medium' ELSE 'low' END AS automation_potential,
  MAP {{'missing_values': 'fill_missing', 'duplicate_records': 'deduplicate', 'encoding_issues': 'normalize_encoding', 'format_inconsistency': 'normalize_format', 'term_variants': 'normalize_label', 'orphan_records': 'manual_review'}}[category] AS action_type
FROM numbered WHERE severity <> 'info' UNION ALL SELECT category, severity, affected_records, 'medium', category FROM numbered WHERE severity <> 'info'""")
def work_packages(spark, sf_dir):
    items, clusters = _queue(spark, sf_dir)
    return report.sorted_packages(report.work_packages(clusters, items)).select("issue_family", "priority", "estimated_records", "automation_potential", "action_type")


@query("work_package_items", f"""WITH {_ITEMS} SELECT n.cluster_id, count(*) AS n FROM items i JOIN numbered n ON i.category = n.category AND n.severity <> 'info'
WHERE i.level <> 'record' GROUP BY 1""")
def work_package_items(spark, sf_dir):
    items, clusters = _queue(spark, sf_dir)
    return report.package_items(clusters, items).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("decided_items", f"""WITH {_D}, latest AS (SELECT item_id, max_by(decision, ord) AS decision, max_by(note, ord) AS note FROM decisions GROUP BY 1)
SELECT o_orderkey AS ord, coalesce(decision, 'pending') AS status, note AS reviewer_note FROM orders LEFT JOIN latest ON item_id = 'rec_' || (o_orderkey % 1000)""")
def decided_items(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("rec_"), (F.col("o_orderkey") % 1000).cast("string")).alias("item_id"), F.lit("pending").alias("status"))
    return review.apply_decisions(items, inputs.derive(spark, sf_dir, "decisions")).select("ord", "status", "reviewer_note")


@query("decision_log", f"WITH {_D} SELECT item_id, decision, ord FROM decisions WHERE ord % 2 = 0 UNION ALL SELECT item_id, decision, ord FROM decisions WHERE ord % 2 = 1")
def decision_log(spark, sf_dir):
    d = inputs.derive(spark, sf_dir, "decisions")
    return review.decision_log(d.where("ord % 2 = 0"), d.where("ord % 2 = 1")).select("item_id", "decision", "ord")


@query("auto_accepted_images", f"""WITH {_I}, c AS (SELECT image_id, review_status, analyzed, coalesce(try_cast(json_extract_string(result, '$.confidence') AS DOUBLE), 0.0) AS confidence FROM images)
SELECT image_id, CASE WHEN review_status = 'pending' AND analyzed AND confidence >= 0.85 THEN 'accepted' ELSE review_status END AS review_status, confidence FROM c""")
def auto_accepted_images(spark, sf_dir):
    from .export import image_confidence

    i = inputs.derive(spark, sf_dir, "images").withColumn("confidence", image_confidence())
    return entities.auto_accept(i, "review_status", 0.85, only=F.col("analyzed")).select("image_id", "review_status", "confidence")


@query("corrected_results", f"""WITH {_I} SELECT image_id, CASE WHEN ord % 6 = 0 THEN 'Neu ' || ord ELSE json_extract_string(result, '$.description') END AS description,
  CASE WHEN ord % 6 = 0 THEN 'geprüft' ELSE NULL END AS checked, CASE WHEN ord % 6 = 0 THEN 'accepted' ELSE review_status END AS review_status FROM images""")
def corrected_results(spark, sf_dir):
    i = inputs.derive(spark, sf_dir, "images")
    maps = i.withColumn("result", F.create_map(F.lit("description"), F.get_json_object("result", "$.description")))
    changes = i.where("ord % 6 = 0").select(
        "image_id", F.create_map(F.lit("description"), F.concat(F.lit("Neu "), "ord"), F.lit("checked"), F.lit("geprüft")).alias("updates"),
        F.lit("accepted").alias("status"), F.lit("manuell").alias("comment"),
    )
    out = review.correct_results(maps, changes)
    return out.select("image_id", F.try_element_at("result", F.lit("description")).alias("description"), F.try_element_at("result", F.lit("checked")).alias("checked"), "review_status")


@query("checked_suggestions", f"""WITH {inputs.cte('suggestions')} SELECT CASE WHEN seq % 11 = 0 THEN 'unknown action' WHEN seq % 13 = 0 THEN 'confidence out of range' END AS reason, count(*) AS n FROM suggestions
WHERE seq % 11 = 0 OR seq % 13 = 0 GROUP BY 1""")
def checked_suggestions(spark, sf_dir):
    s = inputs.derive(spark, sf_dir, "suggestions")
    s = s.withColumn("action_type", F.when(F.col("seq") % 11 == 0, "erase").otherwise(F.col("action_type"))).withColumn("confidence", F.when(F.col("seq") % 13 == 0, 7.0).otherwise(0.5))
    return review.checked_suggestions(s)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("gate_status", f"""WITH {_I}, {_M}, st AS (SELECT unnest(['pending', 'accepted', 'rejected', 'total']) AS status), e AS (SELECT lower(text) AS k, max(gnd_id) AS g FROM mentions WHERE status = 'accepted' GROUP BY 1)
SELECT '1_ocr' AS phase, st.status, (SELECT count(*) FROM images WHERE st.status IN ('total', review_status)) AS n FROM st
UNION ALL SELECT '2_ner', st.status, (SELECT count(*) FROM mentions m WHERE st.status IN ('total', m.status)) FROM st
UNION ALL SELECT '3_authority', st.status, (SELECT count(*) FROM mentions m WHERE m.gnd_id <> '' AND st.status IN ('total', m.status)) FROM st
UNION ALL SELECT 'dictionary', 'total', count(*) FROM e UNION ALL SELECT 'dictionary', 'enriched', count(*) FROM e WHERE g <> '' UNION ALL SELECT 'dictionary', 'unenriched', count(*) FROM e WHERE g = ''""")
def gate_status(spark, sf_dir):
    m = mentions(spark, sf_dir)
    entries = m.where("status = 'accepted'").groupBy(F.lower("text").alias("key")).agg(F.max("gnd_id").alias("gnd_id"))
    return review.gate_status(inputs.derive(spark, sf_dir, "images"), m, m.where("gnd_id <> ''"), entries)


# ---- corrections: the value-level steps of the derived suggestions ----------

def _applied(spark, sf_dir, log=True):
    df = inputs.derive(spark, sf_dir, "labelled").drop("ord")
    return remediation.apply_suggestions(df, inputs.derive(spark, sf_dir, "suggestions"), log=log)


# Fold over the accepted suggestions of one column, in order, per record.
_FOLD = inputs.cte("labelled", "suggestions") + """, acc AS (SELECT *, EXISTS (SELECT 1 FROM labelled l WHERE l.record_id = s.item_id) AS found FROM suggestions s WHERE status = 'accepted'),
rules AS (SELECT target_field, seq, CASE WHEN action_type <> 'normalize_label' AND found THEN item_id END AS rec, CASE WHEN action_type = 'normalize_label' OR NOT found THEN original_value END AS old,
  suggested_value AS new FROM acc WHERE action_type IN ('apply_suggested_value', 'normalize_label', 'move_value_to_field') AND (action_type <> 'move_value_to_field' OR found)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY target_field ORDER BY seq) AS k FROM rules),
vals AS (SELECT 'subject' AS f, record_id, subject AS v FROM labelled UNION ALL SELECT 'source', record_id, source FROM labelled UNION ALL SELECT 'subject_new', record_id, '' FROM labelled),
touched AS (SELECT f, record_id, v, list(struct_pack(seq := seq, rec := rec, old := old, new := new) ORDER BY seq) FILTER (seq IS NOT NULL) AS rs FROM vals LEFT JOIN rules r ON r.target_field = f AND (r.rec = vals.record_id OR r.rec IS NULL) GROUP BY ALL),
done AS (SELECT f, record_id, CASE WHEN rs IS NULL THEN v ELSE list_reduce(list_prepend(v, list_transform(rs, lambda r: CASE WHEN r.rec IS NOT NULL THEN chr(1) || r.new ELSE chr(2) || r.old || chr(3) || r.new END)),
  lambda a, r: CASE WHEN r[1] = chr(1) THEN substr(r, 2) WHEN r[1] = chr(2) AND a = split_part(substr(r, 2), chr(3), 1) THEN split_part(substr(r, 2), chr(3), 2) ELSE a END) END AS v FROM touched)"""


@query("corrected_records", f"""WITH {_FOLD} SELECT record_id, max(v) FILTER (f = 'subject') AS subject, max(v) FILTER (f = 'source') AS source, max(v) FILTER (f = 'subject_new') AS subject_new FROM done GROUP BY 1""")
def corrected_records(spark, sf_dir):
    return _applied(spark, sf_dir, log=False)[0].select("record_id", "subject", "source", "subject_new")


@query("change_log_logged_only", f"WITH {inputs.cte('suggestions')} SELECT suggestion_id, item_id AS record_id, action_type FROM suggestions WHERE status = 'accepted' AND action_type IN ('flag_for_authority_lookup', 'leave_unchanged_mark_uncertain')")
def change_log_logged_only(spark, sf_dir):
    return _applied(spark, sf_dir)[1].where("n_cells = 0").select("suggestion_id", "record_id", "action_type")


_STEP = """lambda a, r: CASE WHEN r[1] = chr(1) THEN substr(r, 2) WHEN r[1] = chr(2) AND a = split_part(substr(r, 2), chr(3), 1) THEN split_part(substr(r, 2), chr(3), 2) ELSE a END"""


@query("change_log", f"""WITH {_FOLD}, steps AS (SELECT f, record_id, v, rs, unnest(generate_series(1, len(rs))) AS i FROM touched WHERE rs IS NOT NULL),
states AS (SELECT f, rs[i] AS r, CASE WHEN i = 1 THEN v ELSE list_reduce(list_prepend(v, list_transform(rs[1:i - 1], lambda r: CASE WHEN r.rec IS NOT NULL THEN chr(1) || r.new ELSE chr(2) || r.old || chr(3) || r.new END)), {_STEP}) END AS before FROM steps),
hits AS (SELECT r.seq AS seq, any_value(f) AS f, count(*) AS n, min(before) AS before FROM states WHERE r.rec IS NOT NULL OR before = r.old GROUP BY 1),
named AS (SELECT suggestion_id, s.seq, CASE action_type WHEN 'normalize_label' THEN 'batch' ELSE coalesce(item_id, '') END AS record_id, f AS "column", before AS original_value, suggested_value AS new_value, action_type, n AS n_cells,
  CASE action_type WHEN 'normalize_label' THEN 'Batch normalization: ' || n || ' cells updated' ELSE '' END AS note FROM hits JOIN suggestions s ON s.seq = hits.seq)
SELECT * FROM named UNION ALL SELECT suggestion_id, seq, coalesce(item_id, ''), coalesce(target_field, ''), original_value, original_value, action_type, 0,
  CASE action_type WHEN 'flag_for_authority_lookup' THEN 'Flagged for authority lookup — value unchanged' ELSE 'Marked as uncertain — value unchanged' END
FROM suggestions WHERE status = 'accepted' AND action_type IN ('flag_for_authority_lookup', 'leave_unchanged_mark_uncertain')""")
def change_log(spark, sf_dir):
    return _applied(spark, sf_dir)[1]


@query("suggestions_dry_run", f"WITH {inputs.cte('suggestions')} SELECT suggestion_id, 'applied' AS status FROM suggestions WHERE status = 'accepted'")
def suggestions_dry_run(spark, sf_dir):
    df = inputs.derive(spark, sf_dir, "labelled")
    would = remediation.apply_suggestions(df, inputs.derive(spark, sf_dir, "suggestions"), dry_run=True)[1]
    return remediation.mark_applied(would).select("suggestion_id", "status")


# ---- stored state -----------------------------------------------------------

@query("upserted_images", f"""WITH {_I} SELECT image_id, CASE WHEN ord % 4 = 0 THEN 'neu' ELSE review_comment END AS review_comment FROM images""")
def upserted_images(spark, sf_dir):
    i = inputs.derive(spark, sf_dir, "images").select("image_id", "review_comment", "ord")
    changed = i.where("ord % 4 = 0").withColumn("review_comment", F.lit("neu"))
    return filters.upsert(i, changed, ["image_id"]).select("image_id", "review_comment")


@query("pending_images", f"WITH {_I} SELECT count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'pending') > 0 AS blocked FROM images")
def pending_images(spark, sf_dir):
    i = inputs.derive(spark, sf_dir, "images")
    return i.agg(F.count_if(F.col("review_status") == "pending").alias("pending")).withColumn("blocked", F.lit(filters.has_pending(i)))


@query("review_export", f"WITH {inputs.cte('suggestions', 'decisions')} SELECT 'suggestions' AS name, count(*) AS n FROM suggestions UNION ALL SELECT 'decisions', count(*) FROM decisions")
def review_export(spark, sf_dir):
    path = scratch_path(spark, "review")
    tables.write_review({n: inputs.derive(spark, sf_dir, n) for n in ("suggestions", "decisions")}, path)
    back = {n: spark.read.schema("status string").json(f"{path}/{n}") for n in ("suggestions", "decisions")}
    return workspace.summary(back)


@query("report_files", f"""WITH {inputs.cte('mentions', 'dates')} SELECT 'entities_by_type_status' AS name, cast(count(*) AS BIGINT) AS n FROM mentions UNION ALL SELECT 'dates_by_method', count(*) FROM dates""")
def report_files(spark, sf_dir):
    path = scratch_path(spark, "report")
    dated = inputs.derive(spark, sf_dir, "dates").withColumn("method", F.lit("rule"))
    empty = spark.createDataFrame([], "severity string, category string")
    counts = report.report_tables(empty, mentions(spark, sf_dir), dated)
    tables.write_report({k: counts[k] for k in ("entities_by_type_status", "dates_by_method")}, path)
    back = {k: spark.read.parquet(f"{path}/{k}") for k in ("entities_by_type_status", "dates_by_method")}
    parts = [t.agg(F.sum("n").alias("n")).withColumn("name", F.lit(k)) for k, t in back.items()]
    return parts[0].unionByName(parts[1])
