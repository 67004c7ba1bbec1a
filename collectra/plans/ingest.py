"""Loading: files are written from the derived inputs, then read like any other."""
from __future__ import annotations

import os
import zipfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import inputs
from ..operators import standard
from ..session import scratch_path
from ..sinks import mets
from ..sinks.common import write_documents
from ..sources import csv as csv_files
from ..sources import files, terms as term_files, workspace, xml as xml_files
from .authority import mentions
from .quality import COLLECTION, collection
from .registry import query


def _csv(spark, sf_dir, encoding="UTF-8", sep=";"):
    path = scratch_path(spark, "csv")
    raw = inputs.derive(spark, sf_dir, "collection_raw")
    options = {"header": True, "sep": sep, "encoding": encoding, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.write.options(**options).csv(path)
    return path


@query("csv_load", f"WITH {COLLECTION} SELECT * FROM collection")
def csv_load(spark, sf_dir):
    return csv_files.load_csv(spark, _csv(spark, sf_dir))


@query("csv_load_cp1252", f"WITH {COLLECTION} SELECT * FROM collection")
def csv_load_cp1252(spark, sf_dir):
    return csv_files.load_csv(spark, _csv(spark, sf_dir, "ISO-8859-1", "\t"))


@query("csv_quoted_breaks", """WITH t AS (SELECT cast(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$', '', 'g') AS text, lang FROM documents)
SELECT doc_id, CASE WHEN text NOT IN ('', 'nan', 'NaN', 'NULL', 'None', 'N/A', 'n/a') THEN text END AS text, lang FROM t""")
def csv_quoted_breaks(spark, sf_dir):
    path = scratch_path(spark, "csv")
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return csv_files.load_csv(spark, path)


@query("csv_ingest_profile", f"""WITH {COLLECTION}, c AS (SELECT unnest(['title', 'creator', 'place']) AS "column", unnest([title, creator, place]) AS value FROM collection)
SELECT "column", count(*) AS total_count, count(value) AS non_null_count, count(DISTINCT value) AS unique_count FROM c GROUP BY 1""")
def csv_ingest_profile(spark, sf_dir):
    profile = csv_files.ingest_csv(spark, _csv(spark, sf_dir))[1]
    return profile.where(F.col("column").isin("title", "creator", "place")).select("column", "total_count", "non_null_count", "unique_count")


@query("csv_preview", "SELECT unnest(['record_id', 'title', 'creator', 'place', 'subject', 'date_text', 'note']) AS name, ';' AS delimiter, 'utf-8' AS encoding, (SELECT count(*) FROM orders) > 0 AS filled")
def csv_preview(spark, sf_dir):
    p = csv_files.preview_csv(spark, _csv(spark, sf_dir))
    names = F.explode(F.array(*[F.lit(c) for c in p["columns"]])).alias("name")
    return p["head"].agg(F.count("*").alias("n")).select(names, F.lit(p["delimiter"]).alias("delimiter"), F.lit(p["encoding"]).alias("encoding"), (F.col("n") > 0).alias("filled"))


_MODS = [("title", "TitleDocMain", False), ("creator", "Creator", True), ("date_text", "DateIssued", False), ("place", "SubjectGeographic", True), ("record_id", "InventoryNumber", False), ("note", "Description", False)]


def _mets(spark, sf_dir):
    path = scratch_path(spark, "mets")
    mapping = spark.createDataFrame([(c, t, "", rep, "", True, i) for i, (c, t, rep) in enumerate(_MODS)], standard.MAPPING)
    mets.write_mets(mets.mods_records(collection(spark, sf_dir), mapping), path, compression="gzip")
    return path


_JOINED = "array_to_string(list_filter(list_transform(string_split({c}, ';'), lambda x: trim(x)), lambda x: x <> ''), '; ')"


@query("mods_load", f"""WITH {COLLECTION} SELECT title, nullif({_JOINED.format(c='creator')}, '') AS name, date_text AS date_issued, nullif({_JOINED.format(c='place')}, '') AS subjects, record_id AS identifier, note AS abstract,
  CASE WHEN creator IS NULL THEN NULL ELSE 'Creator' END AS role FROM collection""")
def mods_load(spark, sf_dir):
    return xml_files.load_xml(spark, _mets(spark, sf_dir)).select("title", "name", "date_issued", "subjects", "identifier", "abstract", "role")


@query("xml_columns", "SELECT unnest(['title', 'name', 'role', 'date_issued', 'subjects', 'identifier', 'identifier_type', 'abstract']) AS name, (SELECT count(*) FROM orders) AS n")
def xml_columns(spark, sf_dir):
    df = xml_files.load_mods(spark, _mets(spark, sf_dir))
    return df.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("name"), "n")


@query("xml_preview", """SELECT 'mets_mods' AS format, unnest(['title', 'name', 'role', 'date_issued', 'subjects', 'identifier', 'identifier_type', 'abstract']) AS name, (SELECT least(10, count(*)) FROM orders) AS head_rows""")
def xml_preview(spark, sf_dir):
    p = xml_files.preview_xml(spark, _mets(spark, sf_dir))
    head = p["head"].agg(F.count("*").alias("head_rows"))
    return head.select(F.lit(next(iter(p["formats"]))).alias("format"), F.explode(F.array(*[F.lit(c) for c in p["columns"]])).alias("name"), "head_rows")


def _lido(spark, sf_dir):
    path = scratch_path(spark, "lido")
    o = inputs.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")

    def t(name, *inner):
        return F.concat(F.lit(f"<lido:{name}>"), *inner, F.lit(f"</lido:{name}>"))

    event = t("eventSet", t("event", F.when(F.col("o_orderkey") % 3 == 0, t("eventType", t("term", F.lit("Acquisition")))).when(
        F.col("o_orderkey") % 3 == 1, t("eventType", t("term", F.lit("Production")))).otherwise(""),
        t("eventActor", t("actorInRole", t("actor", t("nameActorSet", t("appellationValue", F.lit("Actor "), k))), t("roleActor", t("term", F.lit("Maler"))))),
        t("eventDate", t("displayDate", F.lit("um 1900"))), t("eventPlace", t("displayPlace", F.lit("Ort "), k))))
    doc = t(
        "lido", t("descriptiveMetadata", t("objectClassificationWrap", t("objectWorkTypeWrap", t("objectWorkType", t("term", F.lit("Bild"))))),
                  t("objectIdentificationWrap", t("titleWrap", t("titleSet", t("appellationValue", F.lit("Titel "), k), t("appellationValue", F.lit(" Zweit ")))),
                    t("objectMeasurementsWrap", t("objectMeasurementsSet", t("displayObjectMeasurements", F.lit("10 x 20"))))),
                  t("eventWrap", event, event)),
        t("administrativeMetadata", t("recordWrap", t("recordID", F.lit("rec_"), k))),
    )
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<lido:lidoWrap xmlns:lido="http://www.lido-schema.org">'
    write_documents(o.select(doc.alias("xml")), path, head, "</lido:lidoWrap>", compression="gzip")
    return path


@query("lido_load", """SELECT 'Titel ' || o_orderkey || '; Zweit' AS title, 'rec_' || o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Actor ' || o_orderkey || '; Actor ' || o_orderkey END AS name,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'um 1900; um 1900' END AS date_created, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Ort ' || o_orderkey || '; Ort ' || o_orderkey END AS place_of_origin, 'Bild' AS genre, '10 x 20' AS extent FROM orders""")
def lido_load(spark, sf_dir):
    return xml_files.load_xml(spark, _lido(spark, sf_dir)).select("title", "record_id", "name", "date_created", "place_of_origin", "genre", "extent")


#: Members of one archive of the derived input.
ZIP_MEMBERS = 5000


def _zips(spark, sf_dir):
    folder = scratch_path(spark, "zips")
    c = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c.repartition(max(4, c.count() // ZIP_MEMBERS), "c_custkey")  # archives of a size, more for more rows

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        rows = sorted(rows, key=lambda r: r["c_custkey"])
        if not rows:
            return
        with zipfile.ZipFile(os.path.join(folder, f"part-{rows[0]['c_custkey']}.zip"), "w") as zf:
            for r in rows:
                key = r["c_custkey"]
                body = f'<mods:mods xmlns:mods="http://www.loc.gov/mods/v3"><mods:titleInfo><mods:title>{r["c_name"]}</mods:title></mods:titleInfo><mods:identifier type="local">{key}</mods:identifier></mods:mods>'
                if key % 10 == 9:
                    body = "<other/>"
                zf.writestr(f"rec_{key}.xml", body)

    c.foreachPartition(write)
    return folder


@query("zip_load", "SELECT 'rec_' || c_custkey || '.xml' AS member, c_name AS title, cast(c_custkey AS VARCHAR) AS identifier FROM customer WHERE c_custkey % 10 <> 9")
def zip_load(spark, sf_dir):
    return xml_files.load_zip(spark, _zips(spark, sf_dir))[0].select("member", "title", "identifier")


@query("zip_rejects", "SELECT 'rec_' || c_custkey || '.xml' AS member, 'no known records' AS error FROM customer WHERE c_custkey % 10 = 9")
def zip_rejects(spark, sf_dir):
    return xml_files.load_zip(spark, _zips(spark, sf_dir))[1].select("member", "error")


@query("term_list_csv", "SELECT min_by(p_name || ' ' || p_partkey % 50, p_partkey) AS term FROM part GROUP BY lower(p_name || ' ' || p_partkey % 50)")
def term_list_csv(spark, sf_dir):
    path = scratch_path(spark, "terms")
    p = inputs.table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string"))
    p.select(name.alias("term"), F.lit("").alias("replacement"), F.col("p_brand").alias("category"), F.lit("").alias("note")).write.csv(path)
    return term_files.read_csv_terms(spark, path).select("term")


@query("term_list_json", "SELECT DISTINCT p_brand AS term, 'x' AS replacement FROM part")
def term_list_json(spark, sf_dir):
    path = scratch_path(spark, "terms_json")
    brands = inputs.table(spark, sf_dir, "part").select("p_brand").distinct()
    objects = brands.select(F.concat(F.lit("["), F.to_json(F.struct(F.col("p_brand").alias("term"), F.lit("x").alias("ersatz"))), F.lit("]")).alias("value"))
    objects.write.option("maxRecordsPerFile", 1).text(path)
    return term_files.read_json_terms(spark, path).select("term", "replacement")


@query("workspace_summary", f"""WITH {inputs.cte('mentions', 'dates')} SELECT 'entities' AS name, count(*) AS n FROM mentions UNION ALL SELECT 'dates', count(*) FROM dates""")
def workspace_summary(spark, sf_dir):
    path = scratch_path(spark, "workspace")
    workspace.save_workspace({"entities": mentions(spark, sf_dir), "dates": inputs.derive(spark, sf_dir, "dates")}, path)
    return workspace.summary(workspace.load_workspace(spark, path))


@query("file_facts", "SELECT 'utf-8' AS encoding, ';' AS delimiter, 'LF' AS line_ending, false AS has_bom, (SELECT count(*) FROM orders) > 0 AS seen")
def file_facts(spark, sf_dir):
    path = _csv(spark, sf_dir)
    facts = files.file_facts(spark, path, (".csv",))
    return spark.createDataFrame(facts).select("encoding", "delimiter", "line_ending", "has_bom").distinct().withColumn("seen", F.lit(True))


def _projects(spark, sf_dir):
    """One JSON document for each fifty parts, with its dictionary, candidates, tasks and extras."""
    path, p = scratch_path(spark, "projects"), inputs.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    entry = F.struct(
        F.col("p_name").alias("term"), F.concat(F.lit("e"), key).alias("entry_id"), F.lower("p_type").alias("entity_type"), F.array(key, F.lit("r")).alias("record_ids"),
        F.concat(F.lit("Q"), key).alias("wikidata_id"), F.col("p_brand").alias("geonames_preferred"), (F.col("p_size") / 50).alias("confidence"), F.col("p_size").alias("shelf"))
    candidate = F.struct(F.concat(F.lit("e"), key).alias("entry_id"), F.when(F.col("p_size") % 2 == 0, "accepted").alias("status"), F.struct(F.col("p_size").alias("size")).alias("extra"))
    task = F.struct(key.alias("task_id"), F.col("p_size").alias("priority"), F.col("p_brand").alias("note"))
    lists = {"dictionary": entry, "authority_candidates": candidate, "tasks": task}
    docs = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("n")).agg(
        *[F.array_sort(F.collect_list(c)).alias(name) for name, c in lists.items()], F.map_from_entries(F.collect_list(F.struct(key, "p_retailprice"))).alias("extras"))
    body = F.to_json(F.struct(*lists, "extras", F.concat(F.lit("project "), "n").alias("name"), F.array(F.lit("a.csv")).alias("source_files")))
    docs.select(body.alias("value"), "n").write.partitionBy("n").text(path)
    return path


@query("workspace_state_import", """WITH p AS (SELECT *, 'project ' || cast(floor(p_partkey / 50) AS BIGINT) AS project FROM part)
SELECT project, 'dictionary' AS kind, 'e' || p_partkey AS id, concat_ws('|', p_name, lower(p_type), p_partkey || ',r', 'Q' || p_partkey, p_brand, cast(p_size * 2 AS VARCHAR), cast(p_size AS VARCHAR)) AS detail FROM p
UNION ALL SELECT project, 'candidate', 'e' || p_partkey, (CASE WHEN p_size % 2 = 0 THEN 'accepted' ELSE 'pending' END) || '|' || p_size FROM p
UNION ALL SELECT project, 'task', cast(p_partkey AS VARCHAR), p_size || '|' || p_brand FROM p
UNION ALL SELECT project, 'extra', cast(p_partkey AS VARCHAR), cast(cast(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) FROM p
UNION ALL SELECT DISTINCT project, 'project', project, 'a.csv|record_id' FROM p""")
def workspace_state_import(spark, sf_dir):
    t = workspace.import_document(spark, _projects(spark, sf_dir))
    join = lambda *columns: F.concat_ws("|", *columns).alias("detail")
    rows = {
        "dictionary": ("entry_id", join("term", "entity_type", F.concat_ws(",", "record_ids"), "wikidata_id", "geonames_preferred",
                                        F.round(F.col("confidence") * 100).cast("int"), F.get_json_object("item", "$.shelf"))),
        "authority_candidates": ("entry_id", join("status", F.col("extra")["size"])), "tasks": ("task_id", join("priority", "note")),
        "extras": ("key", join(F.col("item").cast("decimal(12, 2)"))), "project": ("name", join(F.concat_ws(";", "source_files"), "id_column")),
    }
    kinds = {"authority_candidates": "candidate", "tasks": "task", "extras": "extra"}
    names = t["project"].select("document", F.col("name").alias("project"))
    out = [t[k].join(names, "document").select("project", F.lit(kinds.get(k, k)).alias("kind"), F.col(i).alias("id"), d) for k, (i, d) in rows.items()]
    return reduce(DataFrame.unionByName, out)
