"""Records and authorities as JSON-LD nodes, one JSON text per row."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ENTITY_TO_SCHEMA, mapped, provenance
from ..functions.text import split_values
from ..operators.joins import lookup_join
from .common import cell, collected, write_documents
from .enriched_csv import result_cells
from .import_xml import mapping_list

# FIXED VALUES: context of the document, and target type -> property.
CONTEXT = {
    "@vocab": "https://schema.org/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "edm": "http://www.europeana.eu/schemas/edm/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "gnd": "https://d-nb.info/gnd/",
    "wikidata": "https://www.wikidata.org/wiki/",
    "edtf": "http://id.loc.gov/datatypes/edtf",
    "identifier": "dc:identifier",
    "subject": "dc:subject",
    "dateCreated": "dcterms:created",
    "temporal": "dcterms:temporal",
}
TO_PROPERTY = {
    "TitleDocMain": "name", "Description": "description", "Creator": "creator", "Publisher": "publisher",
    "DateCreated": "dateCreated", "DateIssued": "datePublished", "Rights": "license", "SubjectTopic": "keywords",
    "SubjectGeographic": "contentLocation", "SubjectPerson": "mentions", "InventoryNumber": "identifier", "CatalogIDDigital": "@id",
}
MENTION_PROPERTY = {"PER": "mentions", "LOC": "contentLocation", "GPE": "contentLocation", "ORG": "accountablePerson"}
PLACEHOLDER = "https://example.org"


def quote(c: Column) -> Column:
    """JSON string of a text."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def _value(c: Column, repeatable: bool) -> Column:
    """JSON of a mapped cell: list for a repeatable multi-value, else string."""
    if not repeatable:
        return quote(c)
    return F.when(c.contains(";"), F.to_json(split_values(c))).otherwise(quote(c))


def check_base_url(base_url: str) -> str:
    if not base_url or base_url.startswith(PLACEHOLDER):
        raise ValueError("a published base URL is needed; placeholder addresses are refused")
    return base_url


def _merged(existing: Column | None, added: Column) -> Column:
    """Existing value(s) first, then the added nodes; a single one stands alone."""
    if existing is None:
        items = added
    else:
        old = F.when(existing.startswith("["), F.transform(F.from_json(existing, "array<string>"), quote)).when(
            existing.isNotNull(), F.array(existing)).otherwise(F.array().cast("array<string>"))
        items = F.when(F.size(added) > 0, F.concat(old, added))
    together = F.when(F.size(items) == 1, F.get(items, F.lit(0))).when(F.size(items) > 1, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    return F.coalesce(together, existing) if existing is not None else together


def _nodes_of(prop: str) -> Column:
    mine = F.filter("_mentions", lambda x: x["p"] == prop)
    return F.coalesce(F.transform(mine, lambda x: x["n"]), F.array().cast("array<string>"))


def record_nodes(
    df: DataFrame, mappings: DataFrame, base_url: str, mentions: DataFrame | None = None, dates: DataFrame | None = None,
    images: DataFrame | None = None, id_column: str = "record_id", statuses: list[str] | None = None,
) -> DataFrame:
    """``(record_id, node)``: one node per row. Mentions of all review states take part unless ``statuses`` says otherwise."""
    check_base_url(base_url)
    active = mapping_list(mappings)
    rid = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    out = df.withColumn("_rid", rid)
    values: dict[str, Column] = {}
    for m in active:
        if m["source_column"] in df.columns:
            c, key = cell(m["source_column"]), TO_PROPERTY.get(m["target_type"], m["target_type"])
            json_value = quote(F.concat(F.lit("urn:glam:"), c)) if key == "@id" else _value(c, m["repeatable"])
            new = F.when(c.isNotNull(), json_value)
            values[key] = F.coalesce(new, values[key]) if key in values else new
    values["identifier"] = F.coalesce(values.get("identifier", F.lit(None).cast("string")), quote(F.col("_rid")))
    values["@id"] = F.coalesce(values.get("@id", F.lit(None).cast("string")), quote(F.concat(F.lit(base_url), F.col("_rid"))))
    if mentions is not None:
        kept = mentions.where(F.col("entity_type").isin(list(MENTION_PROPERTY)))
        if statuses:
            kept = kept.where(F.col("status").isin(statuses))
        same = F.when(F.coalesce("gnd_id", F.lit("")) != "", F.concat(F.lit("https://d-nb.info/gnd/"), "gnd_id"))
        node = F.to_json(F.struct(
            mapped(F.col("entity_type"), ENTITY_TO_SCHEMA, "Thing").alias("@type"), F.coalesce(F.nullif("gnd_preferred", F.lit("")), "text").alias("name"),
            F.col("entity_type").alias("type"), same.alias("sameAs"), F.lit("ner").alias("_source"),
        ))
        kept = kept.select(F.col("record_id").alias("_rid"), "ord", mapped(F.col("entity_type"), MENTION_PROPERTY).alias("p"), node.alias("n"))
        arrays = collected(kept, "_rid", "ord", ["p", "n"], "_mentions")
        out = lookup_join(out, arrays, ["_rid"], "left")
        for prop in sorted(set(MENTION_PROPERTY.values())):
            values[prop] = _merged(values.get(prop), _nodes_of(prop))
    if dates is not None:
        arrays = collected(dates.where("edtf <> ''").withColumnRenamed("record_id", "_rid"), "_rid", "ord", ["edtf"], "_dates")
        out = lookup_join(out, arrays, ["_rid"], "left")
        each = F.transform("_dates", lambda d: F.to_json(F.struct(F.lit("edtf").alias("@type"), d["edtf"].alias("@value"))))
        values["temporal"] = F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
    if images is not None:
        last = result_cells(images).groupBy(F.col("record_id").alias("_rid"), "key").agg(F.max_by("value", "ord").alias("value"))
        maps = last.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_image"))
        out = lookup_join(out, maps, ["_rid"], "left")
        for m in active:
            if m["source_column"].startswith("image."):
                v = F.try_element_at("_image", F.lit(m["source_column"][len("image."):]))
                key = TO_PROPERTY.get(m["target_type"], m["target_type"])
                new = F.when(v.isNotNull(), _value(v, m["repeatable"]))
                values[key] = F.coalesce(new, values[key]) if key in values else new
    pairs = [F.lit('"@type":"CreativeWork"')] + [F.concat(F.lit(json.dumps(k) + ":"), v) for k, v in values.items()]
    return out.select(F.col("_rid").alias("record_id"), F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("node"))


def authority_nodes(entries: DataFrame) -> DataFrame:
    """A node per dictionary entry that has an authority id."""
    def has(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    same = F.filter(F.array(
        F.when(has("gnd_id"), F.concat(F.lit("https://d-nb.info/gnd/"), "gnd_id")),
        F.when(has("wikidata_id"), F.concat(F.lit("https://www.wikidata.org/wiki/"), "wikidata_id")),
    ), lambda x: x.isNotNull())
    node = F.struct(
        F.lit("DefinedTerm").alias("@type"), F.coalesce(F.nullif("gnd_preferred", F.lit("")), "term").alias("name"),
        F.when(has("gnd_id"), F.concat(F.lit("gnd:"), "gnd_id")).alias("@id"), F.when(F.size(same) > 0, same).alias("sameAs"),
    )
    return entries.where(has("gnd_id") | has("wikidata_id") | has("geonames_id")).select("term", F.to_json(node).alias("node"))


def write_jsonld(nodes: DataFrame, path: str, authorities: DataFrame | None = None) -> None:
    """JSON-LD documents, one per part file: the context, and as its graph the nodes of records and,
    where they are given, of authorities."""
    graph = nodes.select("node") if authorities is None else nodes.select("node").unionByName(authorities.select("node"))
    context = json.dumps(CONTEXT, ensure_ascii=False)
    write_documents(graph, path, f'{{"@context": {context}, "@graph": [', "]}", "node", ",")


# ---- image results ----------------------------------------------------------

def image_rows(images: DataFrame, status: str = "") -> DataFrame:
    """Flat result rows; an unknown status gives none."""
    def text(key: str) -> Column:
        return F.coalesce(F.get_json_object("result", f"$.{key}"), F.lit(""))

    def joined(key: str) -> Column:
        return F.coalesce(F.array_join(F.from_json(F.get_json_object("result", f"$.{key}"), "array<string>"), "; "), F.lit(""))

    rows = images.where(F.col("review_status") == status) if status else images
    origin = provenance(source=F.lit("vision_ai"), method=F.lit("llm"), reviewer=F.col("reviewer"), note=F.col("review_comment"))
    return rows.select(
        "image_id", "record_id", "filename", "review_status", "review_comment", "reviewer",
        F.coalesce(F.get_json_object("result", "$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        text("description").alias("description"), joined("objects").alias("objects"), joined("persons").alias("persons"),
        joined("places").alias("places"), text("style").alias("style"), text("period").alias("period"), F.to_json(origin).alias("provenance"),
    )


def image_nodes(rows: DataFrame, base_url: str) -> DataFrame:
    def listed(c: str) -> Column:
        return F.filter(F.split(F.col(c), "; "), lambda x: x != "")

    node = F.struct(
        F.concat(F.lit(base_url), "image_id").alias("@id"), F.lit("ImageObject").alias("@type"), F.col("image_id").alias("identifier"),
        F.col("filename").alias("name"), F.nullif("record_id", F.lit("")).alias("isPartOf"), "description", listed("objects").alias("keywords"),
        listed("places").alias("contentLocation"), listed("persons").alias("about"), "confidence", F.col("review_status").alias("reviewStatus"),
        F.col("review_comment").alias("comment"), F.col("reviewer").alias("creator"), F.col("provenance").alias("prov:wasGeneratedBy"),
    )
    return rows.select("image_id", F.to_json(node).alias("node"))


def technical_rows(images: DataFrame) -> DataFrame:
    wanted = ["image_id", "filename", "media_type", "size_bytes", "width", "height", "hash_sha256", "analyzed", "model", "analyzed_at", "result"]
    return images.select(*[c for c in wanted if c in images.columns])
