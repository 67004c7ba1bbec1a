"""Records as import XML, built from column expressions."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import parse_name
from ..functions.text import safe_file_name, split_values, strip, xml_escape
from ..operators.joins import lookup_join
from ..operators.profile import quoted
from .common import cell, collected, element, gnd_lookup, with_row_hits, write_documents

# FIXED VALUES: element and type names of the import format.
ROOT, BATCH = "goobi-import", "goobi-import-batch"
CATALOG_TYPE, DEFAULT_TYPE = "CatalogIDDigital", "MuseumObject"
PERSON_TYPES = ["Author", "Creator", "Photographer", "Artist", "Editor", "Contributor", "Illustrator"]
CORPORATE_TYPES = ["CorporateBody", "CorporateArtist", "Publisher", "PrintingHouse"]
COLLECTION_TYPES = ["singleDigCollection"]
GND_BASE = "http://d-nb.info/gnd/"


def _authority(part: Column) -> Column:
    found = F.try_element_at(F.col("_auth"), F.lower(part))
    return F.coalesce(
        F.concat(F.lit(f' authority="gnd" authorityURI="{GND_BASE}" valueURI="'), xml_escape(found), F.lit('"')), F.lit("")
    )


def _person(name: Column, label: str, role: str) -> Column:
    parts = parse_name(name)
    return element("person", [("label", label), ("role", role), ("firstname", parts["firstname"]), ("lastname", parts["lastname"])], extra=_authority(name))


def _metadata(value: Column, label: str, kind: str, authority: bool = True) -> Column:
    return element("metadata", [("label", label), ("type", kind)], xml_escape(value), _authority(value) if authority else None)


def _corporate(value: Column, kind: str) -> Column:
    parts = F.when(value.contains("|"), split_values(value, "|")).otherwise(F.array(value))
    name = F.get(parts, F.lit(0))
    head = F.concat(F.lit(f'<corporate role="{kind}" name="'), xml_escape(name), F.lit('"'), _authority(name))
    subs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.concat(F.lit("<subname>"), xml_escape(s), F.lit("</subname>")))
    return F.when(F.size(parts) > 1, F.concat(head, F.lit(">"), F.array_join(subs, ""), F.lit("</corporate>"))).otherwise(F.concat(head, F.lit(" />")))


def mapped_elements(value: Column, target: str, label: str, repeatable: bool) -> Column:
    """XML of one mapped cell, empty text for an empty cell."""
    each = split_values(value)
    if target in PERSON_TYPES:
        names = each if repeatable else F.array(value)
        xml = F.array_join(F.transform(names, lambda n: _person(n, label, target)), "")
    elif target in CORPORATE_TYPES:
        xml = _corporate(value, target)
    elif repeatable or target in COLLECTION_TYPES:
        xml = F.array_join(F.transform(each, lambda v: _metadata(v, label, target)), "")
    else:
        xml = _metadata(value, label, target)
    return F.coalesce(xml, F.lit(""))


def _mention_element() -> Column:
    text = F.col("text")
    own = F.when(F.coalesce("gnd_id", F.lit("")) != "", F.col("gnd_id"))
    found = F.coalesce("_term_gnd", own)
    auth = F.coalesce(F.concat(F.lit(f' authority="gnd" authorityURI="{GND_BASE}" valueURI="'), xml_escape(found), F.lit('"')), F.lit(""))
    name = parse_name(text)
    person = element("person", [("label", "Person"), ("role", "Author"), ("firstname", name["firstname"]), ("lastname", name["lastname"])], extra=auth)
    corporate = element("corporate", [("role", "CorporateBody"), ("name", text)], extra=auth)
    subject = element("metadata", [("label", "Schlagwort"), ("type", "SubjectTopic")], xml_escape(text), auth)
    return F.when(F.col("entity_type") == "PER", person).when(F.col("entity_type") == "ORG", corporate).otherwise(subject)


def mapping_list(mappings: DataFrame) -> list[dict]:
    """Active mappings in order; one row per mapped column of the table."""
    rows = mappings.where(F.col("enabled") & (F.col("target_type") != "__ignore__")).orderBy("ord").collect()
    return [r.asDict() for r in rows]


def _terms(mentions: DataFrame | None, terms: DataFrame) -> DataFrame:
    """Dictionary terms first, then linked mentions whose text is no term."""
    known = terms.select("term", F.coalesce("gnd_id", F.lit("")).alias("gnd_id"), F.lit(0).alias("late"), F.col("ord").cast("long").alias("ord"))
    if mentions is not None:
        linked = mentions.where((F.col("status") != "rejected") & (F.coalesce("gnd_id", F.lit("")) != ""))
        known = known.unionByName(linked.select(F.col("text").alias("term"), "gnd_id", F.lit(1).alias("late"), F.col("ord").cast("long").alias("ord")))
    best = known.groupBy(F.lower("term").alias("term")).agg(F.min_by("gnd_id", F.struct("late", "ord")).alias("gnd_id"))
    return gnd_lookup(best.withColumn("ord", F.lit(0)))


def record_xml(
    df: DataFrame, mappings: DataFrame, terms: DataFrame, mentions: DataFrame | None = None, dates: DataFrame | None = None,
    images: DataFrame | None = None, doc_type: str = DEFAULT_TYPE, auto_catalog_id: bool = True, journal: str = "Import",
) -> DataFrame:
    """``(record_id, xml)``: one document per row.

    Rejected mentions are left out. A missing catalogue id is taken from
    ``record_id`` or refused. Cells equal to the original text of a date of
    their record carry its normalised form.
    """
    active = mapping_list(mappings)
    plain = [m for m in active if not m["source_column"].startswith("image.") and m["source_column"] in df.columns]
    if not any(m["target_type"] == CATALOG_TYPE for m in active):
        if not auto_catalog_id:
            raise ValueError("no column is mapped to the catalogue id")
        if all(m["source_column"] != "record_id" for m in active):
            plain = [{"source_column": "record_id", "target_type": CATALOG_TYPE, "label": CATALOG_TYPE, "repeatable": False}] + plain
    columns = sorted({m["source_column"] for m in plain})
    out = df.select(*[F.col(quoted(c)) for c in df.columns if c in columns or c.lower() == "record_id"])  # rows are written below
    if dates is not None and columns != ["record_id"]:
        known = dates.where("edtf <> ''").groupBy("record_id", F.col("original").alias("text")).agg(F.min_by("edtf", "ord").alias("edtf"))
        cells = F.filter(F.array(*[
            F.struct(F.col("record_id").cast("string").alias("record_id"), cell(c).alias("text"), F.lit(c).alias("name")) for c in columns if c != "record_id"
        ]), lambda s: s["text"].isNotNull())
        out = with_row_hits(out, out.columns, cells, known, ["record_id", "text"], "edtf", "_edtf")
        out = out.withColumns({
            c: F.coalesce(F.try_element_at("_edtf", F.lit(c)), F.col(quoted(c)).cast("string")) for c in columns if c != "record_id"
        }).drop("_edtf")
    pieces = F.flatten(F.array(*[
        F.filter(F.array_distinct(F.concat(
            F.array(F.lower(cell(c))), F.coalesce(F.transform(F.split(cell(c), "[;|]"), lambda p: F.lower(strip(p))), F.array().cast("array<string>"))
        )), lambda p: p.isNotNull() & (p != ""))
        for c in columns
    ]))
    parts = F.transform(F.array_distinct(pieces), lambda p: F.struct(p.alias("part"), p.alias("name")))
    lookup = _terms(mentions, terms)
    out = with_row_hits(out, columns, parts, lookup, ["part"], "gnd_id", "_auth", sparse=True)
    body = [mapped_elements(cell(m["source_column"]), m["target_type"], m["label"] or m["target_type"], m["repeatable"]) for m in plain]
    if mentions is not None:
        kept = mentions.where("status <> 'rejected'").withColumn("part", F.lower("text"))
        keyed = lookup_join(kept, lookup.withColumnRenamed("gnd_id", "_term_gnd"), ["part"], "left").withColumn("_xml", _mention_element())
        arrays = collected(keyed, "record_id", "ord", ["_xml"], "_mentions")
        out = lookup_join(out, arrays, ["record_id"], "left")
        body.append(F.coalesce(F.array_join(F.transform("_mentions", lambda m: m["_xml"]), ""), F.lit("")))
    if images is not None:
        from .enriched_csv import result_cells

        wanted = [m for m in active if m["source_column"].startswith("image.")]
        values = result_cells(images).groupBy("record_id", "key").agg(F.max_by("value", "ord").alias("value"))
        maps = values.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_image"))
        out = lookup_join(out, maps, ["record_id"], "left")
        for m in wanted:
            value = F.try_element_at("_image", F.lit(m["source_column"][len("image."):]))
            each = F.when(value.contains(";"), split_values(value)).otherwise(F.array(value)) if m["repeatable"] else F.array(value)
            label = m["label"] or m["target_type"]
            xml = F.array_join(F.transform(each, lambda v: _metadata(v, label, m["target_type"], False)), "")
            body.append(F.when(value.isNotNull(), xml).otherwise(""))
    record = F.coalesce(F.col("record_id").cast("string"), F.lit(""))
    process = F.concat(
        F.lit("<process><title>"), xml_escape(record), F.lit('</title><journal type="info" creator="- automatic -">'),
        xml_escape(F.lit(journal)), F.lit("</journal></process>"),
    )
    xml = F.concat(F.lit(f'<{ROOT}><data type="'), xml_escape(F.lit(doc_type)), F.lit('">'), *body, F.lit("</data>"), process, F.lit(f"</{ROOT}>"))
    return out.select(record.alias("record_id"), xml.alias("xml"))


def write_batch(xml: DataFrame, path: str) -> None:
    """Batch documents, one per part file."""
    write_documents(xml, path, f'<?xml version="1.0" encoding="UTF-8"?>\n<{BATCH}>', f"</{BATCH}>")


def name_collisions(xml: DataFrame) -> DataFrame:
    """File names that more than one record would get."""
    return xml.groupBy(safe_file_name(F.col("record_id")).alias("file_name")).agg(F.count("*").alias("n")).where("n > 1")


def write_files(xml: DataFrame, folder: str) -> None:
    """One file per record; refuses collisions. ``folder`` may be a URI of any store that
    Arrow knows (hdfs, s3, gs, file); a plain path must be one that all executors see."""
    clash = name_collisions(xml).limit(3).collect()
    if clash:
        raise ValueError(f"file names would collide: {[r[0] for r in clash]}")

    def write(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            target = f"{base.rstrip('/')}/{row['file_name']}.xml"
            part = f"{target}.{uuid.uuid4().hex[:8]}.part"
            with store.open_output_stream(part) as out:
                out.write(("<?xml version='1.0' encoding='utf-8'?>\n" + row["xml"]).encode())
            store.move(part, target)  # a retried task replaces whole files only

    xml.select(safe_file_name(F.col("record_id")).alias("file_name"), "xml").foreachPartition(write)
