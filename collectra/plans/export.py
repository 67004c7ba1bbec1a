"""Exports of the derived collection; written files are read back."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import inputs
from ..functions.codes import row_provenance
from ..operators import dictionary, profile, standard, terms
from ..session import scratch_path
from ..sinks import common, enriched_csv, import_xml, jsonld, mets, tables
from ..sources import csv as csv_files
from .authority import mentions
from .quality import CELLS, COLLECTION, collection
from .registry import query

_M, _I, _D = inputs.cte("mentions"), inputs.cte("images"), inputs.cte("dates")


def image_confidence():
    return F.coalesce(F.get_json_object("result", "$.confidence").try_cast("double"), F.lit(0.0))


def known_terms(spark, sf_dir):
    """Terms with authority ids: every third place name."""
    c = inputs.table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("ort "), "c_custkey").alias("term"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("g"), "c_custkey")).otherwise("").alias("gnd_id"), F.col("c_custkey").alias("ord"),
    )


_TERMS = "terms AS (SELECT 'ort ' || c_custkey AS term, 'g' || c_custkey AS gnd_id FROM customer WHERE c_custkey % 3 = 0)"
_CODES = {"PER": "ner_persons", "ORG": "ner_organisations", "LOC": "ner_places", "GPE": "ner_geo_political", "DAT": "ner_dates_raw", "CON": "ner_concepts"}
_LABELS = f"""{_M}, lab AS (SELECT record_id, entity_type, label, min(ord) AS o FROM (SELECT record_id, entity_type, ord, CASE WHEN gnd_preferred <> '' THEN gnd_preferred ELSE text END AS label FROM mentions) GROUP BY ALL),
cells AS (SELECT record_id, entity_type, string_agg(label, '; ' ORDER BY o) AS t FROM lab GROUP BY ALL)"""


def _pivot_sql(source: str, value: str, names: dict[str, str]) -> str:
    return ", ".join(f"coalesce(max({value}) FILTER (entity_type = '{code}'), '') AS {name}" for code, name in names.items())


@query("enriched_entities", f"""WITH {COLLECTION}, {_LABELS}, wide AS (SELECT record_id, {_pivot_sql('cells', 't', _CODES)} FROM cells GROUP BY 1)
SELECT c.record_id, title, {', '.join(f"coalesce({n}, '') AS {n}" for n in _CODES.values())} FROM collection c LEFT JOIN wide USING (record_id)""")
def enriched_entities(spark, sf_dir):
    df = collection(spark, sf_dir).select("record_id", "title")
    return enriched_csv.enrich(df, mentions(spark, sf_dir)).select("record_id", "title", *_CODES.values())


@query("enriched_dates", f"""WITH {COLLECTION}, {_D}, per AS (SELECT record_id, max_by(edtf, ord) AS e FROM dates WHERE edtf <> '' GROUP BY 1)
SELECT c.record_id, date_text, coalesce(e, '') AS edtf_date_text FROM collection c LEFT JOIN per USING (record_id)""")
def enriched_dates(spark, sf_dir):
    df = collection(spark, sf_dir).select("record_id", "date_text")
    return enriched_csv.edtf_columns(df, inputs.derive(spark, sf_dir, "dates"), "record_id")


@query("enriched_dates_by_text", f"""WITH {COLLECTION}, {_D}, per AS (SELECT original, max_by(edtf, ord) AS e FROM dates GROUP BY 1)
SELECT c.record_id AS nr, date_text, coalesce(e, '') AS edtf_date_text FROM collection c LEFT JOIN per ON original = date_text""")
def enriched_dates_by_text(spark, sf_dir):
    df = collection(spark, sf_dir).select(F.col("record_id").alias("nr"), "date_text")
    return enriched_csv.edtf_columns(df, inputs.derive(spark, sf_dir, "dates"), "record_id")


@query("enriched_images", f"""WITH {COLLECTION}, {_I}, acc AS (SELECT record_id, max_by(json_extract_string(result, '$.description'), ord) AS d,
  max_by(array_to_string(cast(json_extract_string(result, '$.objects[*]') AS VARCHAR[]), '; '), ord) AS o, max_by(json_extract_string(result, '$.confidence'), ord) AS c, max_by(reviewer, ord) AS r, max_by(review_comment, ord) AS rc
  FROM images WHERE review_status = 'accepted' AND record_id <> '' GROUP BY 1)
SELECT c.record_id, coalesce(d, '') AS image_description, coalesce(o, '') AS image_objects, coalesce(acc.c, '') AS image_confidence, coalesce(r, '') AS image_reviewer,
  coalesce(rc, '') AS image_review_comment, CASE WHEN acc.record_id IS NULL THEN '' ELSE 'accepted' END AS image_review_status FROM collection c LEFT JOIN acc USING (record_id)""")
def enriched_images(spark, sf_dir):
    out = enriched_csv.image_columns(collection(spark, sf_dir).select("record_id"), inputs.derive(spark, sf_dir, "images"), "record_id")
    return out.select("record_id", "image_description", "image_objects", "image_confidence", "image_reviewer", "image_review_comment", "image_review_status")


@query("enriched_authority_ids", f"""WITH {COLLECTION}, {_LABELS}, {_TERMS}, hits AS (SELECT record_id, entity_type, gnd_id, min(o) AS o FROM lab JOIN terms ON lower(trim(label)) = term GROUP BY ALL),
pt AS (SELECT record_id, entity_type, string_agg(gnd_id, '; ' ORDER BY o) AS ids FROM hits GROUP BY ALL)
SELECT c.record_id, coalesce(max(ids) FILTER (entity_type = 'PER'), '') AS gnd_persons_ids, coalesce(max(ids) FILTER (entity_type = 'LOC'), '') AS gnd_places_ids, coalesce(max(ids) FILTER (entity_type = 'ORG'), '') AS gnd_organisations_ids
FROM (SELECT record_id, row_number() OVER () AS rn FROM collection) c LEFT JOIN pt USING (record_id) GROUP BY c.record_id, rn""")
def enriched_authority_ids(spark, sf_dir):
    df = collection(spark, sf_dir).select("record_id")
    out = enriched_csv.enrich(df, mentions(spark, sf_dir), terms=known_terms(spark, sf_dir))
    return out.select("record_id", "gnd_persons_ids", "gnd_places_ids", "gnd_organisations_ids")


@query("enriched_combined_ids", f"""WITH {_LABELS}, {_TERMS}, hits AS (SELECT record_id, gnd_id, min(lpad(cast(list_position(['PER', 'ORG', 'LOC', 'GPE', 'FAC', 'EVT', 'WRK', 'DAT', 'ETH', 'CON'], entity_type) AS VARCHAR), 2, '0') || lpad(cast(o AS VARCHAR), 12, '0')) AS pos
FROM lab JOIN terms ON lower(trim(label)) = term WHERE entity_type <> 'TOP' GROUP BY ALL) SELECT record_id, string_agg(gnd_id, '; ' ORDER BY pos) AS gnd_ids FROM hits GROUP BY 1""")
def enriched_combined_ids(spark, sf_dir):
    rows = enriched_csv.labels(mentions(spark, sf_dir))
    return enriched_csv.authority_ids(rows, known_terms(spark, sf_dir))[1]


_SLOTS = {"persons": "PER", "organisations": "ORG", "places": "LOC", "geo_political": "GPE", "dates_raw": "DAT", "concepts": "CON"}


@query("enriched_csv_file", f"""WITH {COLLECTION}, {_LABELS}, {_TERMS}, {_D}, {_I}, wide AS (SELECT record_id, {_pivot_sql('cells', 't', _CODES)} FROM cells GROUP BY 1),
hits AS (SELECT record_id, entity_type, gnd_id, min(o) AS o FROM lab JOIN terms ON lower(trim(label)) = term GROUP BY ALL),
pt AS (SELECT record_id, entity_type, string_agg(gnd_id, '; ' ORDER BY o) AS ids FROM hits GROUP BY ALL),
ids AS (SELECT record_id, {', '.join(f"max(ids) FILTER (entity_type = '{code}') AS gnd_{slot}_ids" for slot, code in _SLOTS.items())} FROM pt GROUP BY 1),
per AS (SELECT record_id, max_by(edtf, ord) AS e FROM dates WHERE edtf <> '' GROUP BY 1),
acc AS (SELECT record_id, max_by(json_extract_string(result, '$.description'), ord) AS d, max_by(json_extract_string(result, '$.confidence'), ord) AS c, max_by(reviewer, ord) AS r
  FROM images WHERE review_status = 'accepted' AND record_id <> '' GROUP BY 1)
SELECT c.record_id, c.title, c.place, c.date_text, {', '.join(f"nullif(wide.{n}, '') AS {n}" for n in _CODES.values())}, {', '.join(f"ids.gnd_{slot}_ids" for slot in _SLOTS)}, e AS edtf_date_text,
  nullif(d, '') AS image_description, nullif(acc.c, '') AS image_confidence, nullif(r, '') AS image_reviewer
FROM collection c LEFT JOIN wide ON wide.record_id = c.record_id LEFT JOIN ids ON ids.record_id = c.record_id LEFT JOIN per ON per.record_id = c.record_id LEFT JOIN acc ON acc.record_id = c.record_id""")
def enriched_csv_file(spark, sf_dir):
    """Every enrichment in one written file, read back as text; blank cells come back null."""
    path = scratch_path(spark, "enriched")
    df = collection(spark, sf_dir).select("record_id", "title", "place", "date_text")
    out = enriched_csv.enrich(
        df, mentions(spark, sf_dir), inputs.derive(spark, sf_dir, "dates"), inputs.derive(spark, sf_dir, "images"), known_terms(spark, sf_dir))
    common.write_csv(out, path, quote_all=False)
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in out.columns)).csv(path)
    return back.select(*df.columns, *_CODES.values(), *[f"gnd_{slot}_ids" for slot in _SLOTS], "edtf_date_text", "image_description", "image_confidence", "image_reviewer")


# ---- import XML -------------------------------------------------------------

def _mapping(spark, rows):
    return spark.createDataFrame([(c, t, label, rep, "", True, i) for i, (c, t, label, rep) in enumerate(rows)], standard.MAPPING)


_XML_ROWS = [("title", "TitleDocMain", "Titel", False), ("place", "SubjectGeographic", "", True), ("note", "Description", "Notiz", False)]
_ESC = "replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_GND = "coalesce(' authority=\"gnd\" authorityURI=\"http://d-nb.info/gnd/\" valueURI=\"' || {g} || '\"', '')"


def _process(rid: str) -> str:
    return f"'</data><process><title>' || {rid} || '</title><journal type=\"info\" creator=\"- automatic -\">Import</journal></process></goobi-import>'"


_PLACES = COLLECTION + f""", rows AS (SELECT *, row_number() OVER () AS rn FROM collection), {_TERMS},
places AS (SELECT rn, string_agg('<metadata label="SubjectGeographic" type="SubjectGeographic"' || {_GND.format(g='gnd_id')} || '>' || v || '</metadata>', '' ORDER BY pos) AS x FROM (
SELECT rn, pos, trim(v) AS v FROM (SELECT rn, unnest(string_split(place, ';')) AS v, generate_subscripts(string_split(place, ';'), 1) AS pos FROM rows WHERE place IS NOT NULL)) LEFT JOIN terms ON term = lower(v) GROUP BY rn)"""


@query("import_xml_records", f"""WITH {_PLACES} SELECT record_id, '<goobi-import><data type="MuseumObject"><metadata label="CatalogIDDigital" type="CatalogIDDigital">' || record_id || '</metadata>'
 || coalesce('<metadata label="Titel" type="TitleDocMain">' || title || '</metadata>', '') || coalesce(x, '') || coalesce('<metadata label="Notiz" type="Description">' || {_ESC.format(v='note')} || '</metadata>', '') || {_process('record_id')} AS xml
FROM rows LEFT JOIN places USING (rn)""")
def import_xml_records(spark, sf_dir):
    return import_xml.record_xml(collection(spark, sf_dir), _mapping(spark, _XML_ROWS), known_terms(spark, sf_dir))


@query("import_xml_date_overrides", f"""WITH {COLLECTION}, {_D}, over AS (SELECT record_id, original, min_by(edtf, ord) AS e FROM dates WHERE edtf <> '' GROUP BY ALL)
SELECT c.record_id, '<goobi-import><data type="MuseumObject"><metadata label="Id" type="CatalogIDDigital">' || c.record_id || '</metadata>' || coalesce('<metadata label="DateIssued" type="DateIssued">' || coalesce(e, date_text) || '</metadata>', '') || {_process('c.record_id')} AS xml
FROM collection c LEFT JOIN over o ON o.record_id = c.record_id AND o.original = c.date_text""")
def import_xml_date_overrides(spark, sf_dir):
    rows = [("record_id", "CatalogIDDigital", "Id", False), ("date_text", "DateIssued", "", False)]
    return import_xml.record_xml(collection(spark, sf_dir), _mapping(spark, rows), known_terms(spark, sf_dir), dates=inputs.derive(spark, sf_dir, "dates"))


@query("import_xml_entities", f"""WITH {COLLECTION}, {_M}, {_TERMS}, lookup AS (SELECT term, gnd_id FROM terms UNION ALL SELECT lower(text), min_by(gnd_id, ord) FROM mentions WHERE status <> 'rejected' AND gnd_id <> '' AND lower(text) NOT IN (SELECT 'ort ' || c_custkey FROM customer) GROUP BY 1),
el AS (SELECT record_id, string_agg('<metadata label="Schlagwort" type="SubjectTopic"' || {_GND.format(g='coalesce(l.gnd_id, nullif(m.gnd_id, chr(0)))')} || '>' || text || '</metadata>', '' ORDER BY ord) AS x
FROM (SELECT * REPLACE (CASE WHEN gnd_id = '' THEN chr(0) ELSE gnd_id END AS gnd_id) FROM mentions WHERE status <> 'rejected' AND entity_type NOT IN ('PER', 'ORG')) m LEFT JOIN lookup l ON l.term = lower(text) GROUP BY 1)
SELECT c.record_id, '<goobi-import><data type="MuseumObject"><metadata label="Id" type="CatalogIDDigital">' || c.record_id || '</metadata>' || coalesce(x, '') || {_process('c.record_id')} AS xml FROM collection c LEFT JOIN el USING (record_id)""")
def import_xml_entities(spark, sf_dir):
    rows = [("record_id", "CatalogIDDigital", "Id", False)]
    m = mentions(spark, sf_dir).where("entity_type NOT IN ('PER', 'ORG') OR gnd_id <> ''").withColumn(
        "status", F.when(F.col("entity_type").isin("PER", "ORG"), F.lit("rejected")).otherwise(F.col("status")))
    linked = mentions(spark, sf_dir).where("gnd_id <> '' AND status <> 'rejected'").select(F.col("text").alias("term"), "gnd_id", (F.col("ord") + 1000).alias("ord"))
    terms = known_terms(spark, sf_dir).unionByName(linked.join(known_terms(spark, sf_dir).select(F.col("term").alias("_t")), F.lower("term") == F.col("_t"), "left_anti"))
    return import_xml.record_xml(collection(spark, sf_dir).select("record_id"), _mapping(spark, rows), terms, m)


@query("import_xml_batch", f"WITH {COLLECTION} SELECT record_id AS process_title, count(*) AS n FROM collection GROUP BY 1")
def import_xml_batch(spark, sf_dir):
    path = scratch_path(spark, "batch")
    import_xml.write_batch(import_xml.record_xml(collection(spark, sf_dir), _mapping(spark, _XML_ROWS), known_terms(spark, sf_dir)), path)
    back = spark.read.format("xml").option("rowTag", "goobi-import").schema("process struct<title:string>").load(path)
    return back.groupBy(F.col("process.title").alias("process_title")).agg(F.count("*").alias("n"))


@query("file_name_collisions", f"WITH {COLLECTION} SELECT record_id AS file_name, count(*) AS n FROM collection GROUP BY 1 HAVING count(*) > 1")
def file_name_collisions(spark, sf_dir):
    return import_xml.name_collisions(collection(spark, sf_dir).select("record_id"))


# ---- METS, JSON-LD ----------------------------------------------------------

_MODS_ROWS = [("title", "TitleDocMain", "", False), ("date_text", "DateIssued", "", False), ("place", "SubjectGeographic", "", True), ("record_id", "CatalogIDDigital", "", False)]
_MPLACES = COLLECTION + """, rows AS (SELECT *, row_number() OVER () AS rn FROM collection), places AS (SELECT rn, string_agg('<mods:subject><mods:geographic>' || trim(v) || '</mods:geographic></mods:subject>', '' ORDER BY pos) AS x FROM (
SELECT rn, unnest(string_split(place, ';')) AS v, generate_subscripts(string_split(place, ';'), 1) AS pos FROM rows WHERE place IS NOT NULL) GROUP BY rn)"""


@query("mods_records", f"""WITH {_MPLACES}, {_D}, temporal AS (SELECT record_id, string_agg('<mods:subject><mods:temporal encoding="edtf">' || edtf || '</mods:temporal></mods:subject>', '' ORDER BY ord) AS t FROM dates WHERE edtf <> '' GROUP BY 1)
SELECT record_id, '<mods:mods version="3.7">' || coalesce('<mods:titleInfo><mods:title>' || title || '</mods:title></mods:titleInfo>', '') || coalesce('<mods:originInfo><mods:dateIssued>' || date_text || '</mods:dateIssued></mods:originInfo>', '')
 || coalesce(x, '') || '<mods:identifier type="catalog">' || record_id || '</mods:identifier>' || coalesce(t, '') || '</mods:mods>' AS mods FROM rows LEFT JOIN places USING (rn) LEFT JOIN temporal USING (record_id)""")
def mods_records(spark, sf_dir):
    return mets.mods_records(collection(spark, sf_dir), _mapping(spark, _MODS_ROWS), dates=inputs.derive(spark, sf_dir, "dates"))


@query("mods_entities", f"""WITH {_M}, k AS (SELECT *, coalesce(nullif(gnd_preferred, ''), text) AS n, CASE WHEN gnd_id <> '' THEN ' authority="gnd" valueURI="http://d-nb.info/gnd/' || gnd_id || '"' ELSE '' END AS a,
  CASE WHEN entity_type IN ('LOC', 'GPE') THEN 0 WHEN entity_type = 'PER' THEN 1 ELSE 2 END AS g FROM mentions WHERE status <> 'rejected' AND entity_type IN ('LOC', 'GPE', 'PER', 'ORG'))
SELECT record_id, '<mods:mods version="3.7">' || string_agg(CASE g WHEN 0 THEN '<mods:subject' || a || '><mods:geographic>' || n || '</mods:geographic></mods:subject>'
  WHEN 1 THEN '<mods:name type="personal"' || a || '><mods:namePart>' || n || '</mods:namePart></mods:name>' ELSE '<mods:name type="corporate"' || a || '><mods:namePart>' || n || '</mods:namePart></mods:name>' END, '' ORDER BY g, ord) || '</mods:mods>' AS mods
FROM k WHERE record_id IN (SELECT 'rec_' || o_orderkey FROM orders) GROUP BY record_id""")
def mods_entities(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "orders").select(F.concat(F.lit("rec_"), "o_orderkey").alias("record_id"))
    out = mets.mods_records(df, _mapping(spark, []), mentions(spark, sf_dir))
    return out.where("mods <> '<mods:mods version=\"3.7\"></mods:mods>'")


@query("mets_documents", f"WITH {COLLECTION} SELECT count(*) AS records, count(title) AS titles FROM collection")
def mets_documents(spark, sf_dir):
    path = scratch_path(spark, "mets")
    mets.write_mets(mets.mods_records(collection(spark, sf_dir), _mapping(spark, _MODS_ROWS)), path)
    schema = "titleInfo struct<title:string>, identifier string"
    back = spark.read.format("xml").option("rowTag", "mods").option("ignoreNamespace", True).schema(schema).load(path)
    return back.agg(F.count("*").alias("records"), F.count("titleInfo.title").alias("titles"))


_JSON_ROWS = [("title", "TitleDocMain", "", False), ("subject", "SubjectTopic", "", True), ("note", "Description", "", False)]


@query("jsonld_records", f"""WITH {COLLECTION}, {_D}, t AS (SELECT record_id, '[' || string_agg('{{"@type":"edtf","@value":"' || edtf || '"}}', ',' ORDER BY ord) || ']' AS t FROM dates WHERE edtf <> '' GROUP BY 1)
SELECT record_id, '{{' || concat_ws(',', '"@type":"CreativeWork"', '"name":"' || title || '"', '"keywords":' || CASE WHEN contains(subject, ';') THEN
  '[' || array_to_string(list_transform(list_filter(list_transform(string_split(subject, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: '"' || x || '"'), ',') || ']' ELSE '"' || subject || '"' END,
  '"description":"' || replace(note, '"', '\\"') || '"', '"identifier":"' || record_id || '"', '"@id":"https://data.museum/' || record_id || '"', '"temporal":' || t) || '}}' AS node FROM collection LEFT JOIN t USING (record_id)""")
def jsonld_records(spark, sf_dir):
    df = collection(spark, sf_dir)
    return jsonld.record_nodes(df, _mapping(spark, _JSON_ROWS), "https://data.museum/", dates=inputs.derive(spark, sf_dir, "dates"))


@query("jsonld_entities", f"""WITH {_M}, n AS (SELECT record_id, ord, CASE WHEN entity_type = 'PER' THEN 'mentions' WHEN entity_type = 'ORG' THEN 'accountablePerson' ELSE 'contentLocation' END AS p FROM mentions WHERE entity_type IN ('PER', 'ORG', 'LOC', 'GPE'))
SELECT record_id, p AS property, count(*) AS n FROM n WHERE record_id IN (SELECT 'rec_' || o_orderkey FROM orders) GROUP BY ALL""")
def jsonld_entities(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "orders").select(F.concat(F.lit("rec_"), "o_orderkey").alias("record_id"))
    nodes = jsonld.record_nodes(df, _mapping(spark, []), "https://data.museum/", mentions(spark, sf_dir))
    props = F.array(*[F.struct(F.lit(p).alias("property"), F.get_json_object("node", f"$.{p}").alias("v")) for p in ("mentions", "contentLocation", "accountablePerson")])
    rows = nodes.select("record_id", F.explode(props).alias("x")).select("record_id", "x.*").where("v IS NOT NULL")
    n = F.when(F.col("v").startswith("["), F.json_array_length("v")).otherwise(1)
    return rows.select("record_id", "property", n.cast("long").alias("n"))


@query("jsonld_authorities", f"""WITH {_TERMS} SELECT term, '{{"@type":"DefinedTerm","name":"' || term || '","@id":"gnd:' || gnd_id || '","sameAs":["https://d-nb.info/gnd/' || gnd_id || '"]}}' AS node FROM terms""")
def jsonld_authorities(spark, sf_dir):
    e = known_terms(spark, sf_dir).withColumns({"wikidata_id": F.lit(""), "geonames_id": F.lit(""), "gnd_preferred": F.lit("")})
    return jsonld.authority_nodes(e)


@query("jsonld_file", f"""WITH {COLLECTION} SELECT 'record' AS kind, record_id AS id, title AS name FROM collection
UNION ALL SELECT 'authority', 'gnd:g' || c_custkey, 'ort ' || c_custkey FROM customer WHERE c_custkey % 3 = 0""")
def jsonld_file(spark, sf_dir):
    """Every part is read back as one JSON document with its context."""
    path = scratch_path(spark, "jsonld")
    terms_ = known_terms(spark, sf_dir).withColumns({c: F.lit("") for c in ("gnd_preferred", "wikidata_id", "geonames_id")})
    jsonld.write_jsonld(jsonld.record_nodes(collection(spark, sf_dir), _mapping(spark, _JSON_ROWS), "https://data.museum/"), path, jsonld.authority_nodes(terms_))
    docs = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    graphs = docs.select(F.variant_get("doc", "$['@graph']", "variant").alias("graph")).where(F.variant_get("doc", "$['@context']", "variant").isNotNull())
    nodes = spark.sql("SELECT e.value AS node FROM {graphs}, LATERAL variant_explode(graph) AS e", graphs=graphs)
    text = lambda key: F.try_variant_get("node", key, "string")
    known = text("$['@type']") == "DefinedTerm"
    return nodes.select(F.when(known, "authority").otherwise("record").alias("kind"), F.when(known, text("$['@id']")).otherwise(text("$.identifier")).alias("id"), text("$.name").alias("name"))


# ---- other tables -----------------------------------------------------------

@query("image_result_rows", f"""WITH {_I} SELECT image_id, review_status, coalesce(try_cast(json_extract_string(result, '$.confidence') AS DOUBLE), 0.0) AS confidence, json_extract_string(result, '$.description') AS description,
  array_to_string(cast(json_extract_string(result, '$.objects[*]') AS VARCHAR[]), '; ') AS objects, array_to_string(cast(json_extract_string(result, '$.places[*]') AS VARCHAR[]), '; ') AS places,
  '{{"source":"vision_ai","method":"llm","model":"","extracted_at":"","reviewed_at":"","reviewer":"' || reviewer || '","note":"' || review_comment || '"}}' AS provenance FROM images WHERE review_status = 'accepted'""")
def image_result_rows(spark, sf_dir):
    rows = jsonld.image_rows(inputs.derive(spark, sf_dir, "images"), "accepted")
    return rows.select("image_id", "review_status", "confidence", "description", "objects", "places", "provenance")


@query("image_result_nodes", f"WITH {_I} SELECT image_id, 'https://data.museum/' || image_id AS node_id, nullif(record_id, '') AS part_of FROM images")
def image_result_nodes(spark, sf_dir):
    nodes = jsonld.image_nodes(jsonld.image_rows(inputs.derive(spark, sf_dir, "images")), "https://data.museum/")
    return nodes.select("image_id", F.get_json_object("node", "$.@id").alias("node_id"), F.get_json_object("node", "$.isPartOf").alias("part_of"))


@query("image_technical_rows", f"WITH {_I} SELECT image_id, filename, width, height, hash_sha256, analyzed, result FROM images")
def image_technical_rows(spark, sf_dir):
    return jsonld.technical_rows(inputs.derive(spark, sf_dir, "images"))


@query("dictionary_json_file", f"""WITH {_M} SELECT min_by(text, ord) AS term, min_by(MAP {{'PER': 'person', 'ORG': 'institution', 'LOC': 'place', 'GPE': 'place', 'CON': 'concept', 'DAT': 'other', 'TOP': 'concept'}}[entity_type], ord) AS entity_type FROM mentions WHERE status = 'accepted' GROUP BY lower(text)""")
def dictionary_json_file(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    tables.write_dictionary(dictionary.from_mentions(mentions(spark, sf_dir)).entries, path)
    return spark.read.schema("term string, entity_type string").json(path).select("term", "entity_type")


@query("mentions_csv_file", f"WITH {_M} SELECT ord, text, entity_type FROM mentions")
def mentions_csv_file(spark, sf_dir):
    path = scratch_path(spark, "mentions")
    tables.write_mentions_csv(mentions(spark, sf_dir).select("ord", "text", "entity_type"), path)
    return spark.read.option("header", True).schema("ord long, text string, entity_type string").csv(path)


@query("term_matches_csv_file", f"""WITH {CELLS}, t AS (SELECT 'Kutsche' AS term, 'Wagen' AS replacement UNION ALL SELECT 'Ansicht', '')
SELECT term, value AS cell_value, "column", record_id, replacement, '' AS category FROM cells, t WHERE dataset = 'collection' AND contains(lower(value), lower(term))""")
def term_matches_csv_file(spark, sf_dir):
    path = scratch_path(spark, "term_matches")
    listed = spark.createDataFrame([("Kutsche", "Wagen", None, "n", 0), ("Ansicht", None, "", "n", 1)], "term string, replacement string, category string, note string, ord int")
    tables.write_term_matches_csv(terms.scan_terms(profile.cells(collection(spark, sf_dir), "record_id"), listed, whole_word=False), path)
    back = csv_files.load_csv(spark, path, delimiter=",").fillna("")
    return back.select("term", "cell_value", "column", "record_id", "replacement", "category")


@query("term_list_csv_file", """SELECT DISTINCT ON (term) p_name || ' "' || p_brand || '", ' || p_size AS term, p_type AS replacement, 'zwei' || chr(10) || 'Zeilen' AS note FROM part ORDER BY term, replacement""")
def term_list_csv_file(spark, sf_dir):
    path, p = scratch_path(spark, "term_list"), inputs.table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", '), "p_size")
    rows = p.groupBy(name.alias("term")).agg(F.min("p_type").alias("replacement")).withColumns({"category": F.lit(None).cast("string"), "note": F.lit("zwei\nZeilen")})
    tables.write_term_list_csv(rows, path)
    return csv_files.load_csv(spark, path, delimiter=",").select("term", "replacement", "note")


_ORIGIN = """'{{"source":"' || {source} || '","method":"' || {method} || '","model":"{model}","extracted_at":"","reviewed_at":"","reviewer":"","note":"' || {note} || '"}}'"""


@query("provenance_rows", f"""WITH {inputs.cte('mentions', 'dates')}
SELECT 'mention' AS kind, cast(ord AS VARCHAR) AS id, {_ORIGIN.format(source='source', method="CASE source WHEN 'rule' THEN 'rule' ELSE 'ner' END", model='m1', note="''")} AS origin FROM mentions
UNION ALL SELECT 'date', cast(ord AS VARCHAR), {_ORIGIN.format(source="'rule'", method="'rule'", model='', note="''")} FROM dates
UNION ALL SELECT 'dictionary', cast(p_partkey AS VARCHAR), {_ORIGIN.format(source="'ocr'", method="'ocr'", model='m2', note='p_name')} FROM part
UNION ALL SELECT 'candidate', cast(p_partkey AS VARCHAR), {_ORIGIN.format(source="'gnd'", method="'api'", model='', note='p_brand')} FROM part""")
def provenance_rows(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    rows = {
        "mention": mentions(spark, sf_dir).select(F.col("ord").alias("id"), "source", F.lit("m1").alias("model")),
        "date": inputs.derive(spark, sf_dir, "dates").select(F.col("ord").alias("id"), F.lit("").alias("source"), F.lit("rule").alias("method")),
        "dictionary": p.select("id", F.lit("ocr").alias("source"), F.lit("m2").alias("model_source"), F.col("p_name").alias("note")),
        "candidate": p.select("id", F.lit("gnd").alias("source"), F.col("p_brand").alias("reviewer_note")),
    }
    out = [t.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(row_provenance(kind, t)).alias("origin")) for kind, t in rows.items()]
    return reduce(DataFrame.unionByName, out)
