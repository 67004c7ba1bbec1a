"""Filters, facets, pages, samples and field mappings."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs
from ..functions.codes import IMAGE_STATUSES, REVIEW_STATUSES
from ..operators import filters, images, sampling, standard
from .quality import COLLECTION, collection
from .registry import query


@query("filter_rules", f"""WITH {COLLECTION} SELECT record_id, title, place FROM collection
WHERE regexp_matches(place, '(?i)ber(n|lin)') AND starts_with(title, 'Ansicht') AND subject = 'KIRCHE'""")
def filter_rules(spark, sf_dir):
    rules = [
        {"column": "place", "value": "ber(n|lin)"}, {"column": "title", "op": "startswith", "value": "Ansicht"},
        {"column": "subject", "op": "equals", "value": "KIRCHE"}, {"column": "unknown", "value": "x"},
    ]
    return filters.apply_rules(collection(spark, sf_dir), rules).select("record_id", "title", "place")


@query("filter_record_ids", f"""WITH {COLLECTION} SELECT record_id, subject FROM collection
WHERE record_id IN (SELECT 'rec_' || doc_id FROM labels WHERE quality = 1)""")
def filter_record_ids(spark, sf_dir):
    ids = inputs.table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("rec_"), "doc_id").alias("id"))
    return filters.apply_rules(collection(spark, sf_dir), [], "record_id", ids).select("record_id", "subject")


_VIEW = {"search": "a", "selected": {"place": ["Berlin", "berlin", "Bern"], "subject": ["KIRCHE", "Kirche; Moschee"]}, "texts": {"title": "ansicht 1"}}
_WHOLE = "contains(lower(concat_ws('|', record_id, title, creator, place, subject, date_text, note)), 'a')"
_P, _S, _X = "coalesce(place IN ('Berlin', 'berlin', 'Bern'), false)", "coalesce(subject IN ('KIRCHE', 'Kirche; Moschee'), false)", "coalesce(contains(lower(title), 'ansicht 1'), false)"


@query("facet_rows", f"WITH {COLLECTION} SELECT record_id, title, place, subject FROM collection WHERE {_WHOLE} AND {_P} AND {_S} AND {_X}")
def facet_rows(spark, sf_dir):
    return filters.faceted_rows(collection(spark, sf_dir), **_VIEW).select("record_id", "title", "place", "subject")


@query("facet_counts", f"""WITH {COLLECTION}
SELECT 'place' AS "column", place AS value, count(*) FILTER ({_WHOLE} AND {_S} AND {_X}) AS n, count(*) AS total FROM collection WHERE place <> '' GROUP BY place
UNION ALL SELECT 'subject', subject, count(*) FILTER ({_WHOLE} AND {_P} AND {_X}), count(*) FROM collection WHERE subject <> '' GROUP BY subject""")
def facet_counts(spark, sf_dir):
    return filters.facet_counts(collection(spark, sf_dir), ["place", "subject"], **_VIEW)


@query("record_id_page", f"""WITH {COLLECTION}, ids AS (SELECT DISTINCT record_id FROM collection WHERE contains(lower(record_id), 'c_1'))
SELECT record_id, (SELECT count(*) FROM ids) > 70 AS has_more FROM ids ORDER BY record_id LIMIT 50 OFFSET 20""")
def record_id_page(spark, sf_dir):
    return filters.id_page(collection(spark, sf_dir), "record_id", "C_1", 20, 50)


@query("record_id_total", f"WITH {COLLECTION} SELECT count(DISTINCT record_id) AS total FROM collection WHERE contains(lower(record_id), 'c_1')")
def record_id_total(spark, sf_dir):
    return filters.id_total(collection(spark, sf_dir), "record_id", "C_1")


@query("item_page", "SELECT event_id, event_type FROM events ORDER BY event_type, event_id LIMIT 40 OFFSET 100")
def item_page(spark, sf_dir):
    return filters.item_page(inputs.table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type", "event_id"], 100, 40)


_M = inputs.cte("mentions")
_I = inputs.cte("images")


@query("entity_filter", f"WITH {_M} SELECT ord, text FROM mentions WHERE status = 'pending' AND entity_type IN ('PER', 'ORG')")
def entity_filter(spark, sf_dir):
    m = inputs.derive(spark, sf_dir, "mentions")
    return filters.by_values(m, status="pending", entity_type=["PER", "ORG"], source="").select("ord", "text")


@query("queue_filter", f"WITH {_M} SELECT ord FROM mentions WHERE confidence >= 0.25 AND confidence <= 0.75 AND source = 'model' AND status = 'pending'")
def queue_filter(spark, sf_dir):
    m = inputs.derive(spark, sf_dir, "mentions").withColumn("confidence", F.col("confidence"))
    return filters.queue_filter(m, status="pending", source="model", min_confidence=0.25, max_confidence=0.75).select("ord")


@query("accepted_images", f"WITH {_I} SELECT image_id, record_id FROM images WHERE review_status = 'accepted'")
def accepted_images(spark, sf_dir):
    return filters.image_filter(inputs.derive(spark, sf_dir, "images"), status="accepted").select("image_id", "record_id")


@query("tiny_images", f"WITH {_I} SELECT image_id, width, height FROM images WHERE width <= 256 OR height <= 256")
def tiny_images(spark, sf_dir):
    return filters.image_filter(inputs.derive(spark, sf_dir, "images"), "tiny").select("image_id", "width", "height")


@query("unanalysed_images", f"WITH {_I} SELECT image_id FROM images WHERE NOT analyzed AND review_status = 'pending'")
def unanalysed_images(spark, sf_dir):
    return filters.image_filter(inputs.derive(spark, sf_dir, "images"), "not_analysed", "pending").select("image_id")


@query("duplicate_images", f"""WITH {_I} SELECT image_id, hash_sha256 FROM images WHERE hash_sha256 <> '' QUALIFY count(*) OVER (PARTITION BY hash_sha256) > 1""")
def duplicate_images(spark, sf_dir):
    return filters.image_filter(inputs.derive(spark, sf_dir, "images"), "duplicates").select("image_id", "hash_sha256")


@query("duplicate_hashes", f"WITH {_I} SELECT hash_sha256, count(*) AS n FROM images WHERE hash_sha256 <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, sf_dir):
    return filters.duplicate_hashes(inputs.derive(spark, sf_dir, "images"))


@query("entity_status_counts", f"""WITH {_M} SELECT s AS status, (SELECT count(*) FROM mentions WHERE s IN ('total', status)) AS n
FROM (SELECT unnest(['pending', 'accepted', 'rejected', 'needs_expert_review', 'applied', 'total']) AS s)""")
def entity_status_counts(spark, sf_dir):
    return filters.status_counts(inputs.derive(spark, sf_dir, "mentions"), "status", REVIEW_STATUSES)


@query("image_status_counts", f"""WITH {_I} SELECT s AS status, (SELECT count(*) FROM images WHERE s IN ('total', review_status)) AS n
FROM (SELECT unnest(['pending', 'accepted', 'rejected', 'total']) AS s)""")
def image_status_counts(spark, sf_dir):
    return filters.status_counts(inputs.derive(spark, sf_dir, "images"), "review_status", IMAGE_STATUSES)


@query("record_images", f"""WITH {_I}, refs AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'C:\\fotos\\bild_' ELSE '/srv/BILD_' END || o_orderkey || '.jpg' AS path FROM orders)
SELECT refs.ord, image_id FROM refs LEFT JOIN images ON lower(regexp_extract(path, '[^/\\\\]*$')) = lower(regexp_extract(filename, '[^/\\\\]*$'))""")
def record_images(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    refs = o.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.when(F.col("o_orderkey") % 2 == 0, "C:\\fotos\\bild_").otherwise("/srv/BILD_"), "o_orderkey", F.lit(".jpg")).alias("path"),
    )
    return images.link_records(refs, "path", inputs.derive(spark, sf_dir, "images")).select("ord", "image_id")


@query("image_link_counts", """SELECT (SELECT count(*) FROM orders o WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_id = o.o_orderkey)) AS matched, (SELECT count(*) FROM orders) AS total""")
def image_link_counts(spark, sf_dir):
    refs = inputs.table(spark, sf_dir, "orders").select(F.concat(F.lit("x/bild_"), "o_orderkey", F.lit(".jpg")).alias("path"))
    return images.link_counts(images.link_records(refs, "path", inputs.derive(spark, sf_dir, "images")))


_H = "md5('42:' || {k})"


@query("sample_rows", f"SELECT o_orderkey FROM orders ORDER BY {_H.format(k='o_orderkey')}, o_orderkey LIMIT 200")
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(inputs.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200)


@query("sample_repeated_ids", f"SELECT l_partkey FROM lineitem ORDER BY {_H.format(k='l_partkey')}, l_partkey LIMIT 1500")
def sample_repeated_ids(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return sampling.sample_rows(lines, "l_partkey", 1500).select("l_partkey")


@query("row_numbers", "SELECT event_id, row_number() OVER (ORDER BY event_type DESC, event_id) AS row_no FROM events")
def row_numbers(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.row_numbers(events, F.desc("event_type"), F.col("event_id")).select("event_id", "row_no")


@query("sample_percent", f"""SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {_H.format(k='o_orderkey')}, o_orderkey) <= greatest(1, round_even((SELECT count(*) FROM orders) * 0.05, 0))""")
def sample_percent(spark, sf_dir):
    return sampling.sample_percent(inputs.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5.0)


@query("sample_stratified", f"""SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H.format(k='o_orderkey')}, o_orderkey)
  <= greatest(1, round_even(count(*) OVER (PARTITION BY o_orderpriority) * 0.02, 0))""")
def sample_stratified(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_stratified(o, "o_orderkey", "o_orderpriority", 0.02)


@query("sampling_plan", f"""WITH s AS (SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM orders) AS t FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_H.format(k='o_orderkey')}, o_orderkey)
  <= greatest(1, round_even(count(*) OVER (PARTITION BY o_custkey) * (100 / t), 0)))
SELECT o_orderkey FROM s ORDER BY {_H.format(k='o_orderkey')}, o_orderkey LIMIT 100""")
def sampling_plan(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.sampling_plan(o, "o_orderkey", n=100, stratify_by="o_custkey").select("o_orderkey")


@query("spot_check_random", f"WITH {_M} SELECT ord FROM mentions WHERE status = 'pending' ORDER BY {_H.format(k='ord')} LIMIT 20")
def spot_check_random(spark, sf_dir):
    return sampling.spot_check(inputs.derive(spark, sf_dir, "mentions")).select("ord")


@query("spot_check_low_confidence", f"WITH {_M} SELECT ord FROM mentions WHERE status = 'pending' ORDER BY confidence, ord LIMIT 30")
def spot_check_low_confidence(spark, sf_dir):
    return sampling.spot_check(inputs.derive(spark, sf_dir, "mentions"), "low_confidence", 30).select("ord")


@query("spot_check_by_type", f"WITH {_M} SELECT ord, entity_type FROM mentions WHERE status = 'pending' ORDER BY entity_type, ord LIMIT 30")
def spot_check_by_type(spark, sf_dir):
    return sampling.spot_check(inputs.derive(spark, sf_dir, "mentions"), "by_type", 30).select("ord", "entity_type")


@query("chunk_sizes", "SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, cast(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 200) + 1 AS BIGINT) AS chunk FROM orders) GROUP BY 1")
def chunk_sizes(spark, sf_dir):
    c = sampling.chunk_numbers(inputs.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("severity_order", f"WITH {_M} SELECT ord FROM mentions ORDER BY CASE WHEN confidence > 0.9 THEN 0 WHEN confidence > 0.5 THEN 1 ELSE 2 END, ord")
def severity_order(spark, sf_dir):
    from ..functions.codes import severity_rank

    sev = F.when(F.col("confidence") > 0.9, "critical").when(F.col("confidence") > 0.5, "warning").otherwise("info")
    m = inputs.derive(spark, sf_dir, "mentions").withColumn("severity", sev)
    return m.orderBy(severity_rank(F.col("severity")), "ord").select("ord")


@query("union_by_name", "SELECT 'doc_' || doc_id AS record_id, lang, NULL AS role FROM documents UNION ALL SELECT 'conv_' || conv_id || '_' || turn, NULL, role FROM conversations")
def union_by_name(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("record_id"), "lang")
    c = inputs.table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv_"), "conv_id", F.lit("_"), "turn").alias("record_id"), "role")
    return d.unionByName(c, allowMissingColumns=True)


@query("id_sets", """SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def id_sets(spark, sf_dir):
    a, b = (inputs.table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    sides = {"both": a.intersect(b), "documents": a.subtract(b), "labels": b.subtract(a)}
    out = None
    for name, ids in sides.items():
        row = ids.agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


# ---- field standard ---------------------------------------------------------

_MAP = [
    ("record_id", "CatalogIDDigital", True), ("title", "TitleDocMain", True), ("creator", "Creator", True), ("place", "SubjectGeographic", True),
    ("note", "Description", True), ("subject", "SubjectTopic", False), ("empty", "Rights", True), ("date_text", "DateIssued", True),
]


def mappings(spark):
    rows = [(c, t, t, c in ("creator", "subject", "place"), "", e, i) for i, (c, t, e) in enumerate(_MAP)]
    return spark.createDataFrame(rows, standard.MAPPING)


def _standard(spark, sf_dir):
    df = collection(spark, sf_dir).withColumn("empty", F.lit(None).cast("string"))
    return standard.validate(df, mappings(spark))


_FIELDS = """(VALUES ('Identifikator', 'CatalogIDDigital', 2.0, 'record_id'), ('Titel', 'TitleDocMain', 2.0, 'title'), ('Objekttyp', 'DocStruct', 2.0, ''),
 ('Aufbewahrungsort', 'PlaceOfPublication', 2.0, ''), ('Rechtliche Informationen', 'Rights', 2.0, 'empty'), ('Beschreibung', 'Description', 1.0, 'note'),
 ('Datierung', 'DateCreated', 1.0, ''), ('Abmessungen/Umfang', 'Dimensions', 1.0, ''), ('Material/Technik', 'MaterialDescription', 1.0, ''),
 ('Hersteller/Urheber', 'Creator', 1.0, 'creator'), ('Abbildungsnachweis', 'Source', 1.0, ''), ('Schlagwörter', 'SubjectTopic', 1.0, ''),
 ('Herstellungsort', 'SubjectGeographic', 1.0, 'place'), ('Sammlung', 'singleDigCollection', 1.0, '')) f(name, target_type, w, c)"""
_RATES = COLLECTION + f""", counts AS (SELECT count(*) AS total, count(record_id) AS record_id, count(title) AS title, count(note) AS note, count(creator) AS creator, count(place) AS place FROM collection),
std AS (SELECT name, target_type, w, c, total, coalesce(CASE c WHEN 'record_id' THEN record_id WHEN 'title' THEN title WHEN 'note' THEN note WHEN 'creator' THEN creator WHEN 'place' THEN place END, 0) AS filled FROM {_FIELDS}, counts)"""


@query("standard_validation", f"WITH {_RATES} SELECT name AS field, target_type, c <> '' AS mapped, c AS source_column, filled AS filled_count, total AS record_count FROM std")
def standard_validation(spark, sf_dir):
    return _standard(spark, sf_dir).select("field", "target_type", "mapped", "source_column", "filled_count", "record_count")


@query("standard_score", f"""WITH {_RATES} SELECT count(*) FILTER (w = 2 AND c <> '') AS required_mapped, count(*) FILTER (w = 2) AS required_total,
count(*) FILTER (w = 2 AND filled > 0) AS required_filled, round(sum(filled / total * w) / sum(w), 4) AS completeness_score FROM std""")
def standard_score(spark, sf_dir):
    return standard.score(_standard(spark, sf_dir)).withColumn("completeness_score", F.round("completeness_score", 4))


_TASKS = _RATES + """, tasks AS (SELECT name AS field, CASE WHEN c = '' THEN 'map_field' ELSE 'fill_data' END AS category,
CASE WHEN c = '' THEN CASE WHEN w = 2 THEN 0 ELSE 3 END WHEN filled = 0 THEN CASE WHEN w = 2 THEN 1 ELSE 4 END ELSE CASE WHEN w = 2 THEN 2 ELSE 4 END END AS priority,
CASE WHEN c <> '' AND filled > 0 THEN total - filled ELSE total END AS record_count FROM std WHERE c = '' OR filled / total < 0.5)"""


@query("curation_tasks", f"WITH {_TASKS} SELECT field, category, priority, record_count FROM tasks")
def curation_tasks(spark, sf_dir):
    return standard.tasks(_standard(spark, sf_dir)).select("field", "category", "priority", "record_count")


@query("new_tasks", f"WITH {_TASKS} SELECT field, category FROM tasks WHERE priority > 0 UNION ALL SELECT field, category FROM tasks WHERE priority = 0")
def new_tasks(spark, sf_dir):
    all_tasks = standard.tasks(_standard(spark, sf_dir))
    return standard.add_new_tasks(all_tasks.where("priority = 0"), all_tasks).select("field", "category")


@query("active_mappings", f"""WITH {COLLECTION} SELECT m.c AS "column", m.t AS target_type, CASE m.c WHEN 'record_id' THEN count(record_id) WHEN 'title' THEN count(title) WHEN 'creator' THEN count(creator)
  WHEN 'place' THEN count(place) WHEN 'note' THEN count(note) ELSE count(date_text) END / count(*) AS fill_rate
FROM collection, (VALUES ('record_id', 'CatalogIDDigital'), ('title', 'TitleDocMain'), ('creator', 'Creator'), ('place', 'SubjectGeographic'), ('note', 'Description'), ('date_text', 'DateIssued')) m(c, t) GROUP BY m.c, m.t""")
def active_mappings(spark, sf_dir):
    rates = collection(spark, sf_dir)
    from ..operators.profile import fill_rates

    active = filters.active_mappings(mappings(spark))
    return fill_rates(rates).join(F.broadcast(active), F.col("column") == F.col("source_column")).select("column", "target_type", "fill_rate")
