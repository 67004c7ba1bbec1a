"""METS documents with one MODS section per record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import mapped
from ..functions.text import split_values, utc_timestamp, xml_escape
from ..operators.joins import lookup_join
from .common import cell, collected, write_bounded
from .enriched_csv import result_cells
from .import_xml import mapping_list

# FIXED VALUES: namespaces, and target type -> MODS element.
METS_NS, MODS_NS, XLINK_NS = "http://www.loc.gov/METS/", "http://www.loc.gov/mods/v3", "http://www.w3.org/1999/xlink"
TO_MODS = {
    "TitleDocMain": "titleInfo", "Description": "abstract", "Creator": "name", "Publisher": "originInfo",
    "DateCreated": "originInfo", "DateIssued": "originInfo", "Rights": "accessCondition", "SubjectTopic": "subject",
    "SubjectGeographic": "subject", "SubjectPerson": "subject", "SubjectCorporation": "subject",
    "InventoryNumber": "identifier", "CatalogIDDigital": "recordInfo",
}
GND_BASE = "http://d-nb.info/gnd/"


def tag(name: str, inner: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<mods:{name}{attributes}>"), inner, F.lit(f"</mods:{name}>"))


def _one(value: Column, target: str) -> Column | None:
    """MODS of one value; None for targets MODS has no place for."""
    v, kind = xml_escape(value), TO_MODS.get(target)
    if kind == "titleInfo":
        return tag("titleInfo", tag("title", v))
    if kind == "abstract":
        return tag("abstract", v)
    if kind == "name":
        return tag("name", F.concat(tag("namePart", v), tag("role", tag("roleTerm", F.lit(target), ' type="text"'))), ' type="personal"')
    if kind == "subject":
        inner = {
            "SubjectGeographic": lambda: tag("geographic", v),
            "SubjectPerson": lambda: tag("name", tag("namePart", v), ' type="personal"'),
            "SubjectCorporation": lambda: tag("name", tag("namePart", v), ' type="corporate"'),
        }.get(target, lambda: tag("topic", v))
        return tag("subject", inner())
    if kind == "identifier":
        return tag("identifier", v, f' type="{target.lower()}"')
    if kind == "recordInfo":
        return tag("identifier", v, ' type="catalog"')
    if kind == "accessCondition":
        return tag("accessCondition", v, ' type="use and reproduction"')
    if kind == "originInfo":
        return tag("dateIssued" if target in ("DateCreated", "DateIssued") else "publisher", v)
    return None


def _mapped(value: Column, m: dict) -> Column:
    each = split_values(value) if m["repeatable"] else F.array(value)
    xml = F.array_join(F.transform(each, lambda v: _one(v, m["target_type"])), "")
    return F.when(value.isNotNull(), xml).otherwise("")


def _mention() -> Column:
    """MODS of a mention; places, persons and organisations only."""
    name = F.coalesce(F.nullif("gnd_preferred", F.lit("")), "text")
    auth = F.when(F.coalesce("gnd_id", F.lit("")) != "", F.concat(F.lit(f' authority="gnd" valueURI="{GND_BASE}'), xml_escape(F.col("gnd_id")), F.lit('"'))).otherwise("")

    def named(kind: str) -> Column:
        return F.concat(F.lit(f'<mods:name type="{kind}"'), auth, F.lit(">"), tag("namePart", xml_escape(name)), F.lit("</mods:name>"))

    place = F.concat(F.lit("<mods:subject"), auth, F.lit(">"), tag("geographic", xml_escape(name)), F.lit("</mods:subject>"))
    return F.when(F.col("entity_type").isin("LOC", "GPE"), place).when(F.col("entity_type") == "PER", named("personal")).when(F.col("entity_type") == "ORG", named("corporate"))


_GROUP = {"LOC": "0", "GPE": "0", "PER": "1", "ORG": "2"}


def mods_records(
    df: DataFrame, mappings: DataFrame, mentions: DataFrame | None = None, dates: DataFrame | None = None, images: DataFrame | None = None,
    id_column: str = "record_id",
) -> DataFrame:
    """``(record_id, mods)``: one record per row."""
    active = mapping_list(mappings)
    out = df.withColumn("_rid", F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    if images is not None:
        values = collected(result_cells(images), ["record_id", "key"], "ord", ["value"], "_v")
        joined = values.withColumn("value", F.array_join(F.transform("_v", lambda p: p["value"]), "; "))
        maps = joined.groupBy(F.col("record_id").alias("_rid")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_image"))
        out = lookup_join(out, maps, ["_rid"], "left")

    def value_of(m: dict) -> Column | None:
        c = m["source_column"]
        if c.startswith("image."):
            return F.try_element_at("_image", F.lit(c[len("image."):])) if images is not None else None
        return cell(c) if c in df.columns else None

    usable = [(m, value_of(m)) for m in active if m["target_type"] in TO_MODS]
    usable = [(m, v) for m, v in usable if v is not None]
    origin = [(m, v) for m, v in usable if TO_MODS[m["target_type"]] == "originInfo"]
    body, origin_done = [], False
    for m, v in usable:
        if TO_MODS[m["target_type"]] != "originInfo":
            body.append(_mapped(v, m))
        elif not origin_done:  # all dates and publishers share one element
            inner = F.concat(*[_mapped(w, n) for n, w in origin])
            body.append(F.when(inner != "", tag("originInfo", inner)).otherwise(""))
            origin_done = True
    if mentions is not None:
        kept = mentions.where("status <> 'rejected'").withColumn("_xml", _mention()).where("_xml IS NOT NULL")
        kept = kept.withColumn("_at", F.struct(mapped(F.col("entity_type"), _GROUP).alias("g"), "ord"))
        arrays = collected(kept.withColumnRenamed("record_id", "_rid"), "_rid", "_at", ["_xml"], "_mentions")
        out = lookup_join(out, arrays, ["_rid"], "left")
        body.append(F.coalesce(F.array_join(F.transform("_mentions", lambda x: x["_xml"]), ""), F.lit("")))
    if dates is not None:
        kept = dates.where("edtf <> ''").withColumnRenamed("record_id", "_rid")
        arrays = collected(kept, "_rid", "ord", ["edtf"], "_dates")
        out = lookup_join(out, arrays, ["_rid"], "left")
        each = F.transform("_dates", lambda d: tag("subject", tag("temporal", xml_escape(d["edtf"]), ' encoding="edtf"')))
        body.append(F.coalesce(F.array_join(each, ""), F.lit("")))
    xml = F.concat(F.lit('<mods:mods version="3.7">'), *body, F.lit("</mods:mods>"))
    return out.select(F.col("_rid").alias("record_id"), xml.alias("mods"))


def write_mets(mods: DataFrame, path: str, label: str = "Export", compression: str = "none") -> None:
    """METS documents of bounded size, one per part file, the structMap listing the records of
    that document."""
    stamp = mods.sparkSession.range(1).select(F.date_format(F.to_timestamp(utc_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    head = (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<mets:mets xmlns:mets="{METS_NS}" xmlns:mods="{MODS_NS}" xmlns:xlink="{XLINK_NS}" OBJID="export">'
        f'<mets:metsHdr CREATEDATE="{stamp}" RECORDSTATUS="Complete" />'
    )
    start = f'<mets:fileSec><mets:fileGrp USE="metadata" /></mets:fileSec><mets:structMap TYPE="physical"><mets:div TYPE="document" LABEL="{label}">'

    def document():
        divs: list[str] = []

        def text(attribute: str, xml: str) -> str:
            i = len(divs)
            divs.append(f'<mets:div TYPE="record" LABEL="{attribute}" DMDID="dmd{i}" />')
            return f'<mets:dmdSec ID="dmd{i}"><mets:mdWrap MDTYPE="MODS"><mets:xmlData>{xml}</mets:xmlData></mets:mdWrap></mets:dmdSec>'

        return head, text, lambda: "\n".join([start, *divs, "</mets:div></mets:structMap></mets:mets>"])

    write_bounded(mods.select(xml_escape(F.col("record_id")).alias("attribute"), "mods"), path, document, compression)
