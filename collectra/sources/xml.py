"""MODS and LIDO records as flat tables, also from ZIP archives."""
from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.profile import Dataset, column_profile, drop_empty_columns, id_candidates, value_counts
from ..session import cut_lineage
from .csv import describe
from .files import xml_formats

_S = "array<string>"
MODS_SCHEMA = (
    f"titleInfo array<struct<title:{_S},subTitle:{_S}>>, name array<struct<namePart:{_S},role:array<struct<roleTerm:{_S}>>>>, "
    f"originInfo array<struct<place:array<struct<placeTerm:{_S}>>,publisher:{_S},dateIssued:{_S},dateCreated:{_S}>>, "
    f"language array<struct<languageTerm:{_S}>>, physicalDescription array<struct<form:{_S},extent:{_S}>>, abstract {_S}, "
    f"subject array<struct<topic:{_S},geographic:{_S}>>, identifier array<struct<_VALUE:string,_type:string>>, "
    f"recordInfo array<struct<recordIdentifier:{_S}>>, accessCondition {_S}, note {_S}, genre {_S}, typeOfResource {_S}"
)
LIDO_SCHEMA = (
    f"descriptiveMetadata array<struct<objectClassificationWrap:array<struct<objectWorkTypeWrap:array<struct<objectWorkType:array<struct<term:{_S}>>>>>>,"
    f"objectIdentificationWrap:array<struct<titleWrap:array<struct<titleSet:array<struct<appellationValue:{_S}>>>>,"
    f"objectDescriptionWrap:array<struct<objectDescriptionSet:array<struct<descriptiveNoteValue:{_S}>>>>,"
    f"objectMeasurementsWrap:array<struct<objectMeasurementsSet:array<struct<displayObjectMeasurements:{_S}>>>>>>,"
    f"eventWrap:array<struct<eventSet:array<struct<event:array<struct<eventType:array<struct<term:{_S}>>,"
    f"eventActor:array<struct<actorInRole:array<struct<actor:array<struct<nameActorSet:array<struct<appellationValue:{_S}>>>>,roleActor:array<struct<term:{_S}>>>>>>,"
    f"eventDate:array<struct<displayDate:{_S}>>,eventPlace:array<struct<displayPlace:{_S}>>>>>>>>,"
    f"objectRelationWrap:array<struct<subjectWrap:array<struct<subjectSet:array<struct<subject:array<struct<subjectConcept:array<struct<term:{_S}>>>>>>>>>>>>, "
    f"administrativeMetadata array<struct<recordWrap:array<struct<recordID:{_S}>>,rightsWorkWrap:array<struct<rightsWorkSet:array<struct<rightsType:array<struct<term:{_S}>>>>>>>>"
)
MAX_MEMBER_BYTES = 1 << 30
# Members that leave a task together: a batch for each would cost more than its member.
MEMBERS, MEMBER_CHARS = 1000, 1 << 22


def _steps(root: Column, path: str) -> Column:
    out = root
    for step in path.split("."):
        out = _down(out, step)
    return out


def _down(c: Column, step: str) -> Column:
    return F.flatten(F.filter(F.transform(c, lambda x: x[step]), lambda a: a.isNotNull()))


def _texts(c: Column) -> Column:
    return F.filter(F.transform(c, lambda t: strip(t)), lambda t: t.isNotNull() & (t != ""))


def _first(c: Column) -> Column:
    """Text of the first element, null when it is empty."""
    return F.nullif(strip(F.get(c, F.lit(0))), F.lit(""))


def _join(c: Column) -> Column:
    return F.nullif(F.array_join(_texts(c), "; "), F.lit(""))


def mods_fields(df: DataFrame, *keep: str) -> DataFrame:
    """The twenty flat fields of MODS records."""
    c = F.col
    names = F.transform("name", lambda n: F.array_join(_texts(F.coalesce(n["namePart"], F.array().cast(_S))), ", "))
    ids = F.filter("identifier", lambda i: strip(i["_VALUE"]) != "")
    typed = F.transform(ids, lambda i: F.struct(F.coalesce(i["_type"], F.lit("unknown")).alias("t"), strip(i["_VALUE"]).alias("v")))
    first_type = F.get(typed, F.lit(0))["t"]

    def last_of(kind: Column) -> Column:
        return F.try_element_at(F.filter(typed, lambda i: i["t"] == kind), F.lit(-1))["v"]

    return df.select(
        *keep,
        _first(_steps(c("titleInfo"), "title")).alias("title"), _first(_steps(c("titleInfo"), "subTitle")).alias("subtitle"), _join(names).alias("name"),
        _first(_steps(c("name"), "role.roleTerm")).alias("role"), _first(_steps(c("originInfo"), "place.placeTerm")).alias("place_of_origin"),
        _first(_steps(c("originInfo"), "publisher")).alias("publisher"), _first(_steps(c("originInfo"), "dateIssued")).alias("date_issued"),
        _first(_steps(c("originInfo"), "dateCreated")).alias("date_created"), _first(_steps(c("language"), "languageTerm")).alias("language"),
        _first(_steps(c("physicalDescription"), "form")).alias("physical_form"), _first(_steps(c("physicalDescription"), "extent")).alias("extent"),
        _first(c("abstract")).alias("abstract"),
        _join(F.concat(*[F.coalesce(_steps(c("subject"), s), F.array().cast(_S)) for s in ("topic", "geographic")])).alias("subjects"),
        F.coalesce(last_of(F.lit("local")), last_of(F.lit("uri")), last_of(first_type)).alias("identifier"), first_type.alias("identifier_type"),
        _first(_steps(c("recordInfo"), "recordIdentifier")).alias("record_id"), _first(c("accessCondition")).alias("access_condition"),
        _first(c("note")).alias("note"), _first(c("genre")).alias("genre"), _first(c("typeOfResource")).alias("type_of_resource"),
    )


def lido_fields(df: DataFrame, *keep: str) -> DataFrame:
    """The eleven flat fields of LIDO records. Only production events, and
    events without a type, name people, dates and places."""
    d, a = F.col("descriptiveMetadata"), F.col("administrativeMetadata")
    events = F.filter(
        _steps(d, "eventWrap.eventSet.event"),
        lambda e: F.coalesce(F.lower(F.coalesce(_first(_down(e["eventType"], "term")), F.lit(""))).isin("", "production"), F.lit(True)),
    )

    def of_events(path: str) -> Column:
        return _join(_steps(events, path))

    wrap = "objectIdentificationWrap"
    return df.select(
        *keep,
        _join(_steps(d, f"{wrap}.titleWrap.titleSet.appellationValue")).alias("title"), _first(_steps(a, "recordWrap.recordID")).alias("record_id"),
        _join(_steps(d, f"{wrap}.objectDescriptionWrap.objectDescriptionSet.descriptiveNoteValue")).alias("abstract"),
        of_events("eventActor.actorInRole.actor.nameActorSet.appellationValue").alias("name"), of_events("eventActor.actorInRole.roleActor.term").alias("role"),
        of_events("eventDate.displayDate").alias("date_created"), of_events("eventPlace.displayPlace").alias("place_of_origin"),
        _join(_steps(d, "objectRelationWrap.subjectWrap.subjectSet.subject.subjectConcept.term")).alias("subjects"),
        _join(_steps(d, "objectClassificationWrap.objectWorkTypeWrap.objectWorkType.term")).alias("genre"),
        _join(_steps(d, f"{wrap}.objectMeasurementsWrap.objectMeasurementsSet.displayObjectMeasurements")).alias("extent"),
        _join(_steps(a, "rightsWorkWrap.rightsWorkSet.rightsType.term")).alias("access_condition"),
    )


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, ignoreNamespace=True).schema(schema).load(path)


def load_mods(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    flat = mods_fields(_read(spark, path, "mods", MODS_SCHEMA))
    return flat if keep_empty else drop_empty_columns(cut_lineage(flat))  # parsed once, counted from the table


def load_lido(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    flat = lido_fields(_read(spark, path, "lido", LIDO_SCHEMA))
    return flat if keep_empty else drop_empty_columns(cut_lineage(flat))


def load_xml(spark: SparkSession, path: str, skip_unknown: bool = False) -> DataFrame:
    """All MODS and LIDO files below a path, united by column name. A file of another
    kind is an error, or left out with ``skip_unknown`` (``xml_formats`` names it)."""
    found = xml_formats(spark, path)
    unknown = found.pop("unknown", [])
    if unknown and not (skip_unknown and found):
        raise ValueError(f"the root element is neither METS/MODS nor LIDO: {unknown[:20]}")
    lido = found.pop("lido", [])
    mods = [f for files in found.values() for f in files]
    frames = [load(spark, files) for load, files in ((load_mods, mods), (load_lido, lido)) if files]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)


def preview_xml(spark: SparkSession, path: str, rows: int = 10, sample: int = 1000) -> dict:
    """What an import would see: the formats with their numbers of files, the filled columns, the first rows and
    likely id columns of the first ``sample`` records, warnings about files of another kind."""
    found = xml_formats(spark, path)
    unknown = found.pop("unknown", [])
    if not found:
        raise ValueError(f"the root element is neither METS/MODS nor LIDO: {unknown[:20]}")
    kind = "lido" if "lido" in found else next(iter(found))
    load = load_lido if kind == "lido" else load_mods
    top = drop_empty_columns(cut_lineage(load(spark, found[kind], keep_empty=True).limit(sample)))
    return {
        "formats": {k: len(v) for k, v in found.items()}, "columns": top.columns, "head": top.limit(rows),
        "id_candidates": id_candidates(column_profile(value_counts(top)), top.columns), "warnings": [f"not read: {f}" for f in unknown],
    }


def ingest_xml(spark: SparkSession, path: str) -> tuple[Dataset, DataFrame]:
    return describe(load_xml(spark, path), os.path.splitext(os.path.basename(path.rstrip("/")))[0])


def _decoded(raw: bytes) -> str:
    """A well-formed document as text without comments, by its byte order mark or declaration."""
    expat.ParserCreate().Parse(raw, True)
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = raw.decode("utf-16")
    else:
        declared = re.match(rb"""(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)""", raw)
        text = raw.decode(declared[1].decode() if declared and not raw.startswith(b"\xef\xbb\xbf") else "utf-8-sig")
    return re.sub(r"<!--.*?-->", "", re.sub(r"^\s*<\?xml.*?\?>", "", text, flags=re.S), flags=re.S)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, member, xml, error)``: one row per XML file in the archives.
    Archives are spread over tasks; members are read one at a time and handed on some at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "xml", "error"]
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    zf = zipfile.ZipFile(io.BytesIO(content))
                    names = sorted(n for n in zf.namelist() if n.lower().endswith(".xml"))
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(archive, None, None, str(e))], columns=columns)
                    continue
                rows, filled = [], 0
                for name in names:
                    try:
                        if zf.getinfo(name).file_size > MAX_MEMBER_BYTES:
                            raise ValueError("member is too large for one row")
                        row = (archive, name, _decoded(zf.read(name)), None)
                    except Exception as e:  # a bad member must not stop the archive
                        row = (archive, name, None, f"{type(e).__name__}: {e}")
                    rows.append(row)
                    filled += len(row[2] or "")
                    if len(rows) == MEMBERS or filled >= MEMBER_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, filled = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(unpack, "archive string, member string, xml string, error string")


def _fragments(members: DataFrame, tag: str, schema: str) -> DataFrame:
    pattern = rf"(?s)<(?:[\w.\-]+:)?{tag}(?=[\s>/]).*?</(?:[\w.\-]+:)?{tag}\s*>"
    parts = members.select("archive", "member", F.posexplode(F.regexp_extract_all("xml", F.lit(pattern), F.lit(0))).alias("pos", "part"))
    return parts.select("archive", "member", "pos", F.from_xml("part", schema, {"ignoreNamespace": "true"}).alias("r")).select("archive", "member", "pos", "r.*")


def load_zip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records of all XML members, rejected members). MODS and LIDO members
    may be mixed; columns are united by name."""
    members = zip_members(spark, path)
    good = members.where("xml IS NOT NULL")
    keys = ("archive", "member")
    mods = mods_fields(_fragments(good, "mods", MODS_SCHEMA), *keys)
    lido = lido_fields(_fragments(good, "lido", LIDO_SCHEMA), *keys)
    known = F.col("xml").rlike(r"<(?:[\w.\-]+:)?(?:mods|lido)[\s>/]")
    rejects = members.where(F.col("xml").isNull() | ~known).select("archive", "member", F.coalesce("error", F.lit("no known records")).alias("error"))
    return mods.unionByName(lido, allowMissingColumns=True), rejects

