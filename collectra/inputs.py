"""Collection-shaped inputs derived from the given tables.

Every input is one SELECT in the dialect Spark and DuckDB share, so both sides
of a comparison start from the same rows. Defects (gaps, duplicates, mojibake,
mixed separators, spelling variants) are planted by key arithmetic and grow
with the tables.
"""
from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_ORDERS = """(SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % 18 AS k, 15 + o_custkey % 6 AS cent,
    cast(extract(year FROM o_orderdate) AS string) AS y, cast(1 + o_custkey % 28 AS string) || '.' || cast(1 + o_custkey % 12 AS string) || '.' AS dm
  FROM {orders}) o"""
_DATE_TEXT = """CASE k WHEN 0 THEN y WHEN 1 THEN 'ca. ' || y WHEN 2 THEN y || '-2010' WHEN 3 THEN 'vor ' || y
    WHEN 4 THEN 'NACH ' || y WHEN 5 THEN substring(y, 1, 3) || '0er Jahre' WHEN 6 THEN cast(cent AS string) || '. Jh.'
    WHEN 7 THEN 'Anfang ' || cast(cent AS string) || '. Jahrhundert' WHEN 8 THEN dm || y WHEN 9 THEN 'Mai ' || y
    WHEN 10 THEN y || ' Dez' WHEN 11 THEN 'Sommer ' || y WHEN 12 THEN '[' || y || ']' WHEN 13 THEN 'o.D.'
    WHEN 14 THEN 'keine Ahnung ' || cast(o_custkey AS string) WHEN 15 THEN 'ca. ' || y || ' bis 2015'
    WHEN 16 THEN y || '/03/15' ELSE ' ' || y || '-07 ' END"""

SQL: dict[str, tuple[list[str], str]] = {
    # name: (what it reads, SELECT)
    "collection_raw": (["orders"], f"""
SELECT 'rec_' || cast(CASE WHEN o_orderkey % 40 = 39 THEN o_orderkey - 1 ELSE o_orderkey END AS string) AS record_id,
  CASE WHEN o_orderkey % 20 = 3 THEN NULL
       WHEN o_orderkey % 20 = 7 THEN '' WHEN o_orderkey = 78 THEN 'BÃ¼hne'
       WHEN o_orderkey % 20 = 11 THEN 'GemÃ¤lde ' || cast(o_custkey AS string)
       WHEN o_orderkey % 20 = 13 THEN '  Ansicht ' || cast(o_custkey AS string) || ' '
       ELSE 'Ansicht ' || cast(o_custkey AS string) END AS title,
  CASE WHEN o_orderkey % 9 = 1 THEN 'N/A'
       WHEN o_orderkey % 3 = 0 THEN NULL
       WHEN o_custkey % 4 = 0 THEN 'Müller, Friedrich ' || cast(o_custkey % 7 AS string)
       WHEN o_custkey % 4 = 1 THEN 'Johann Wolfgang von Goethe' || cast(o_custkey % 7 AS string)
       WHEN o_custkey % 4 = 2 THEN 'Maria de la Cruz; Meier, Hans' || cast(o_custkey % 7 AS string)
       ELSE 'Keller' || cast(o_custkey % 7 AS string) END AS creator,
  CASE o_custkey % 9 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'berlin' WHEN 2 THEN 'BERLIN'
       WHEN 3 THEN 'Bern; Zürich' WHEN 4 THEN 'Basel, Genf' WHEN 5 THEN 'Wien; Graz, Linz'
       WHEN 6 THEN 'Ort ' || cast(o_custkey % 50 AS string) WHEN 7 THEN 'Bern' ELSE NULL END AS place,
  CASE o_orderkey % 7 WHEN 0 THEN 'Kirche; Moschee' WHEN 1 THEN 'kirche | Turm' WHEN 2 THEN 'KIRCHE'
       WHEN 3 THEN 'Berg;Tal; Fluss' WHEN 4 THEN 'Ã¶lmühle' WHEN 5 THEN o_orderpriority
       ELSE lower(o_orderpriority) || '; tal' END AS subject,
  {_DATE_TEXT} AS date_text,
  CASE o_orderkey % 6 WHEN 0 THEN 'nan' WHEN 1 THEN 'Kutsche und Pferd, um ' || cast(o_custkey AS string)
       WHEN 2 THEN '   ' WHEN 3 THEN 'Bemerkung: Alte Mühle (St. Gallen), Kutschen'
       WHEN 4 THEN 'Das alte Haus; Pferd "Rosa"' ELSE NULL END AS note
FROM {_ORDERS}"""),
    "date_texts": (["orders"], f"""
SELECT 'rec_' || cast(o_orderkey AS string) AS record_id, {_DATE_TEXT} AS text, o_orderkey AS ord FROM {_ORDERS}"""),
    "mentions": (["events"], """
SELECT 'rec_' || cast(cast(floor(event_id / 3) AS bigint) AS string) AS record_id,
  CASE event_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'place' ELSE 'note' END AS source_column,
  CASE WHEN event_id % 4 = 0 THEN upper('Ort ' || cast(user_id % 60 AS string))
       WHEN event_id % 4 = 1 THEN 'ort ' || cast(user_id % 60 AS string)
       WHEN event_id % 8 = 3 THEN ' Ort ' || cast(user_id % 60 AS string) || ' '
       ELSE 'Ort ' || cast(user_id % 60 AS string) END AS text,
  CASE WHEN event_id % 11 = 0 THEN 'TOP' WHEN event_id % 11 = 5 THEN 'DAT'
       WHEN event_type = 'view' THEN 'LOC' WHEN event_type = 'click' THEN 'PER'
       WHEN event_type = 'purchase' THEN 'ORG' WHEN event_type = 'signup' THEN 'GPE' ELSE 'CON' END AS entity_type,
  (event_id * 37 % 101) / 100.0E0 AS confidence,
  CASE WHEN event_id % 2 = 0 THEN 'model' ELSE 'rule' END AS source,
  CASE WHEN event_id % 5 = 0 THEN 'accepted' WHEN event_id % 5 = 1 THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN event_id % 7 = 0 THEN 'g' || cast(user_id % 60 AS string) ELSE '' END AS gnd_id,
  CASE WHEN event_id % 7 = 0 THEN 'Ort, ' || cast(user_id % 60 AS string) ELSE '' END AS gnd_preferred,
  event_id AS ord
FROM {events}"""),
    "dates": (["orders"], f"""
SELECT 'rec_' || cast(CASE WHEN o_orderkey % 40 = 39 THEN o_orderkey - 1 ELSE o_orderkey END AS string) AS record_id,
  'date_text' AS source_column, trim({_DATE_TEXT}) AS original,
  CASE WHEN o_orderkey % 18 IN (13, 14) THEN '' ELSE y || '~' END AS edtf, o_orderkey AS ord
FROM {_ORDERS} WHERE o_orderkey % 5 <> 4"""),
    "authority": (["part"], """
SELECT 'a' || cast(p_partkey AS string) AS authority_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'Ort ' || cast(p_partkey % 90 AS string)
       ELSE p_name || ' ' || cast(p_partkey AS string) END AS preferred_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'ort ' || cast(p_partkey % 70 AS string) || '; ' || p_brand
       ELSE '' END AS variants,
  CASE WHEN p_partkey % 5 = 0 THEN 'Person' WHEN p_partkey % 5 = 1 THEN 'CorporateBody'
       WHEN p_partkey % 5 = 2 THEN 'SubjectHeading' ELSE 'PlaceOrGeographicName' END AS authority_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'wikidata' WHEN p_partkey % 4 = 1 THEN 'geonames' ELSE 'gnd' END AS source,
  p_partkey AS ord
FROM {part}"""),
    "wide_ne": (["orders"], """
SELECT 'rec_' || cast(o_orderkey + 100 AS string) AS record_id,
  'Ort ' || cast(o_custkey % 80 AS string) AS named_entity_1,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'g' || cast(o_custkey % 80 AS string) END AS named_entity_1_gnd_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Ort ' || cast(o_custkey % 80 AS string) ELSE NULL END AS "named_entity_1_gnd_preferredName",
  'PlaceOrGeographicName' AS named_entity_1_gnd_type,
  cast(50 + o_orderkey % 10 * 5 AS string) || '%' AS named_entity_1_gnd_konfidenz,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Platz; ORT ' || cast(o_custkey % 80 AS string) ELSE '' END AS named_entity_1_gnd_alternativen,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Kein GND-Match' WHEN o_orderkey % 4 = 1 THEN 'API-Abfrage empfohlen' ELSE '' END AS named_entity_1_gnd_begruendung,
  'Person ' || cast(o_custkey % 30 AS string) AS named_entity_2,
  CASE WHEN o_orderkey % 5 = 0 THEN ' p' || cast(o_custkey % 30 AS string) WHEN o_orderkey % 5 = 1 THEN '  ' ELSE NULL END AS named_entity_2_gnd_id,
  cast(NULL AS string) AS "named_entity_2_gnd_preferredName",
  'Person' AS named_entity_2_gnd_type,
  '0.' || cast(5 + o_orderkey % 5 AS string) AS named_entity_2_gnd_konfidenz,
  '' AS named_entity_2_gnd_alternativen,
  'api-abfrage EMPFOHLEN' AS named_entity_2_gnd_begruendung,
  o_orderkey AS ord
FROM {orders}"""),
    "images": (["events"], """
SELECT 'img_' || cast(event_id AS string) AS image_id,
  CASE WHEN event_id % 10 = 9 THEN '' ELSE 'rec_' || cast(cast(floor(event_id / 2) AS bigint) AS string) END AS record_id,
  'scans/' || event_type || '/Bild_' || cast(event_id AS string) || '.JPG' AS filename,
  '{"description": "Bild ' || event_type || '", "objects": ["Haus ' || cast(user_id % 9 AS string) || '", "Baum"], "persons": [], "places": ["Ort '
    || cast(user_id % 60 AS string) || '"], "style": "", "transcription": "Kutsche vor Ort ' || cast(user_id % 60 AS string)
    || '", "confidence": ' || CASE WHEN event_id % 13 = 0 THEN '"hoch"' ELSE '0.' || cast(10 + event_id % 90 AS string) END || '}' AS result,
  CASE WHEN event_id % 3 = 0 THEN 'accepted' WHEN event_id % 3 = 1 THEN 'pending' ELSE 'rejected' END AS review_status,
  CASE WHEN event_id % 3 = 0 THEN 'gut' ELSE '' END AS review_comment,
  CASE WHEN event_id % 2 = 0 THEN 'anna' ELSE '' END AS reviewer,
  (event_id % 4 <> 1) AS analyzed,
  CASE WHEN event_id % 19 = 0 THEN '' ELSE 'h' || cast(event_id % 700 AS string) END AS hash_sha256,
  64 * (1 + event_id % 9) AS width, 48 * (1 + event_id % 11) AS height, event_id AS ord
FROM {events}"""),
    "labelled": (["documents"], """
SELECT 'doc_' || cast(doc_id AS string) AS record_id, lang, source,
  CASE WHEN doc_id % 3 = 0 THEN 'Kirche' WHEN doc_id % 3 = 1 THEN 'kirche' ELSE 'Dom' END AS subject,
  doc_id AS ord FROM {documents}"""),
    "suggestions": (["labels"], """
SELECT 's' || cast(doc_id AS string) AS suggestion_id,
  CASE doc_id % 7 WHEN 0 THEN 'apply_suggested_value' WHEN 1 THEN 'apply_suggested_value' WHEN 2 THEN 'normalize_label'
       WHEN 3 THEN 'move_value_to_field' WHEN 4 THEN 'flag_for_authority_lookup' WHEN 5 THEN 'split_multi_value'
       ELSE 'leave_unchanged_mark_uncertain' END AS action_type,
  CASE WHEN doc_id % 7 = 1 THEN 'Dom' WHEN doc_id % 7 = 2 THEN CASE doc_id % 2 WHEN 0 THEN 'kirche' ELSE 'Kirche' END
       ELSE 'x' || cast(doc_id % 5 AS string) END AS original_value,
  CASE WHEN doc_id % 7 = 2 THEN CASE doc_id % 2 WHEN 0 THEN 'Kirche' ELSE 'Gotteshaus' END
       WHEN doc_id % 7 = 1 THEN 'Kathedrale'
       ELSE 'Wert ' || cast(doc_id AS string) END AS suggested_value,
  CASE WHEN doc_id % 7 = 1 THEN 'doc_missing' ELSE 'doc_' || cast(doc_id AS string) END AS item_id,
  CASE WHEN doc_id % 7 = 3 THEN 'subject_new' WHEN doc_id % 14 = 0 THEN 'source' ELSE 'subject' END AS target_field,
  CASE WHEN quality = 1 THEN 'accepted' ELSE 'pending' END AS status,
  (toxic = 1) AS is_ai_based, doc_id AS seq
FROM {labels}"""),
    "decisions": (["labels"], """
SELECT 'rec_' || cast(doc_id % 300 AS string) AS item_id,
  CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision,
  'anna' AS reviewer, 'note ' || cast(doc_id AS string) AS note, doc_id AS ord
FROM {labels}"""),
}


MIN_SPLIT_BYTES = 256 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Use more cores on an input with fewer splits than its size allows, such as
    one small file. A table of many files has splits enough and is left as it
    is, and no split gets smaller than ``MIN_SPLIT_BYTES``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, size // MIN_SPLIT_BYTES)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input as a lazy projection over the given tables."""
    reads, select = SQL[name]
    for t in reads:
        view = f"given_{t}_{zlib.crc32(sf_dir.encode()):08x}"
        table(spark, sf_dir, t).createOrReplaceTempView(view)
        select = select.replace("{" + t + "}", view)
    return spark.sql(select.replace('"named_entity', "`named_entity").replace('preferredName"', "preferredName`"))


def cte(*names: str) -> str:
    """The same inputs as DuckDB common table expressions."""
    parts = []
    for name in names:
        reads, select = SQL[name]
        for t in reads:
            select = select.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({select})")
    return ", ".join(parts)
