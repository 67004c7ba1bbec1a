"""Mentions, dictionary and authority matching."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs
from ..functions.text import split_values
from ..operators import authority, dictionary, entities, profile, similarity
from .quality import COLLECTION, collection
from .registry import query

_M = inputs.cte("mentions")
_W = inputs.cte("wide_ne")
_A = inputs.cte("authority")


def mentions(spark, sf_dir):
    return inputs.derive(spark, sf_dir, "mentions")


def authorities(spark, sf_dir):
    return inputs.derive(spark, sf_dir, "authority").withColumn("variants", split_values(F.col("variants")))


@query("unique_mentions", f"""WITH {_M} SELECT ord, text, entity_type, confidence FROM mentions
QUALIFY row_number() OVER (PARTITION BY lower(trim(text)), entity_type ORDER BY confidence DESC, ord) = 1""")
def unique_mentions(spark, sf_dir):
    return entities.unique_mentions(mentions(spark, sf_dir)).select("ord", "text", "entity_type", "confidence")


@query("unique_mentions_per_record", f"""WITH {_M} SELECT ord, record_id FROM mentions
QUALIFY row_number() OVER (PARTITION BY record_id, lower(trim(text)), entity_type ORDER BY confidence DESC, ord) = 1""")
def unique_mentions_per_record(spark, sf_dir):
    return entities.unique_mentions(mentions(spark, sf_dir), ["record_id"]).select("ord", "record_id")


@query("merged_extractions", f"""WITH {_M}, best AS (SELECT *, lower(trim(text)) || '||' || entity_type AS k FROM mentions
QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY confidence DESC, ord) = 1),
a AS (SELECT * FROM best WHERE source = 'rule'), b AS (SELECT * FROM best WHERE source = 'model')
SELECT CASE WHEN a.k IS NULL OR b.confidence >= a.confidence THEN b.ord ELSE a.ord END AS ord,
  CASE WHEN a.k IS NULL THEN 'model' WHEN b.k IS NULL THEN 'rule' ELSE 'hybrid' END AS source FROM a FULL JOIN b USING (k)""")
def merged_extractions(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return entities.merge_extractions(m.where("source = 'rule'"), m.where("source = 'model'")).select("ord", "source")


@query("mention_type_counts", f"""WITH {_M} SELECT entity_type, count(*) AS n,
  MAP {{'PER': 'Person', 'ORG': 'Organisation', 'LOC': 'Ort/Geografie', 'GPE': 'Geo-politische Einheit', 'DAT': 'Datum/Zeit', 'CON': 'Konzept/Thema', 'TOP': 'Thema/Schlagwort'}}[entity_type] AS label
FROM mentions WHERE entity_type IN ('PER', 'ORG', 'LOC', 'DAT') GROUP BY ALL""")
def mention_type_counts(spark, sf_dir):
    return entities.type_counts(entities.of_types(mentions(spark, sf_dir), ["PER", "ORG", "LOC", "DAT"]))


@query("stored_mentions", f"""WITH {_M}, x AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS late, CASE WHEN ord % 5 < 3 THEN 'rec_1' ELSE record_id END AS rec FROM mentions)
SELECT lower(text) AS text_key, entity_type, rec AS record_id, min_by(ord, late * 1000000000 + ord) AS ord, max(confidence) AS confidence FROM x GROUP BY ALL""")
def stored_mentions(spark, sf_dir):
    m = mentions(spark, sf_dir).withColumn("record_id", F.when(F.col("ord") % 5 < 3, "rec_1").otherwise(F.col("record_id")))
    out = entities.add_mentions(m.where("ord % 3 = 0"), m.where("ord % 3 <> 0"))
    return out.select(F.lower("text").alias("text_key"), "entity_type", "record_id", "ord", "confidence")


@query("auto_accepted_mentions", f"""WITH {_M} SELECT status2 AS status, count(*) AS n FROM (SELECT CASE WHEN status = 'pending' AND confidence >= 0.8 AND entity_type IN ('PER', 'LOC') THEN 'accepted' ELSE status END AS status2 FROM mentions) GROUP BY 1""")
def auto_accepted_mentions(spark, sf_dir):
    done = entities.auto_accept(mentions(spark, sf_dir), "status", 0.8, ["PER", "LOC"])
    return done.groupBy("status").agg(F.count("*").alias("n"))


_GAZ = "(VALUES ('Berlin', 'GPE'), ('Kirche', 'CON'), ('Ort 13', 'LOC'), ('Wolfgang von', 'PER'), ('Tal', 'LOC')) g(term, entity_type)"


@query("gazetteer_mentions", f"""WITH {COLLECTION}, c AS (SELECT record_id, 'creator' AS source_column, creator AS value FROM collection UNION ALL SELECT record_id, 'place', place FROM collection
UNION ALL SELECT record_id, 'subject', subject FROM collection)
SELECT record_id, source_column, term AS text, entity_type FROM c, {_GAZ} WHERE regexp_matches(lower(value), '(^|[\\s,;.!?"''()\\[\\]])' || lower(term) || '($|[\\s,;.!?"''()\\[\\]])')""")
def gazetteer_mentions(spark, sf_dir):
    known = spark.createDataFrame(
        [("Berlin", "GPE", 0), ("Kirche", "CON", 1), ("Ort 13", "LOC", 2), ("Wolfgang von", "PER", 3), ("Tal", "LOC", 4)],
        "term string, entity_type string, ord int",
    )
    cells = profile.cells(collection(spark, sf_dir), "record_id", ["creator", "place", "subject"])
    return entities.gazetteer_mentions(cells, known).select("record_id", "source_column", "text", "entity_type")


# ---- wide authority table ---------------------------------------------------

_LONG = _W + """, long AS (
SELECT record_id, ord, 1 AS slot, coalesce(trim(named_entity_1), '') AS term, trim(named_entity_1_gnd_id) AS authority_id,
  coalesce(nullif(trim("named_entity_1_gnd_preferredName"), ''), trim(named_entity_1)) AS preferred_name, named_entity_1_gnd_type AS authority_type,
  cast(replace(named_entity_1_gnd_konfidenz, '%', '') AS DOUBLE) / 100.0 AS confidence, named_entity_1_gnd_alternativen AS alts FROM wide_ne WHERE trim(named_entity_1_gnd_id) <> ''
UNION ALL SELECT record_id, ord, 2, trim(named_entity_2), trim(named_entity_2_gnd_id), trim(named_entity_2), named_entity_2_gnd_type,
  cast(named_entity_2_gnd_konfidenz AS DOUBLE), named_entity_2_gnd_alternativen FROM wide_ne WHERE trim(named_entity_2_gnd_id) <> '')"""


@query("wide_authority_matches", f"""WITH {_LONG} SELECT record_id, slot, term, authority_id, preferred_name, authority_type, confidence,
  CASE WHEN alts = '' THEN 0 ELSE len(string_split(alts, ';')) END AS n_alternatives FROM long""")
def wide_authority_matches(spark, sf_dir):
    m = authority.wide_matches(inputs.derive(spark, sf_dir, "wide_ne"))
    return m.select("record_id", "slot", "term", "authority_id", "preferred_name", "authority_type", "confidence", F.size("alternatives").alias("n_alternatives"))


@query("low_confidence_matches", f"WITH {_LONG} SELECT record_id, term, authority_id, confidence, slot FROM long WHERE confidence < 0.75")
def low_confidence_matches(spark, sf_dir):
    return authority.low_confidence(authority.wide_matches(inputs.derive(spark, sf_dir, "wide_ne")))


@query("dictionary_from_authority", f"""WITH {_LONG} SELECT coalesce(nullif(lower(preferred_name), ''), lower(term)) AS key, coalesce(nullif(preferred_name, ''), term) AS term, authority_id, authority_type, confidence
FROM long QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(lower(preferred_name), ''), lower(term)) ORDER BY confidence DESC, ord, slot) = 1""")
def dictionary_from_authority(spark, sf_dir):
    return dictionary.from_matches(authority.wide_matches(inputs.derive(spark, sf_dir, "wide_ne")))


# ---- dictionary -------------------------------------------------------------

_TERMS = COLLECTION + """, term_rows AS (
SELECT record_id, 0 AS c, generate_subscripts(p, 1) AS pos, unnest(p) AS term FROM (SELECT record_id, list_filter(list_transform(string_split(place, ';'), lambda x: trim(x)), lambda x: x <> '') AS p FROM collection)
UNION ALL SELECT record_id, 1, generate_subscripts(p, 1), unnest(p) FROM (SELECT record_id, list_filter(list_transform(string_split(subject, ';'), lambda x: trim(x)), lambda x: x <> '') AS p FROM collection)),
entries AS (SELECT lower(term) AS key, min_by(term, record_id || '|' || c || '|' || pos) AS term, count(*) AS occurrences FROM term_rows GROUP BY 1)"""


def terms_of(spark, sf_dir):
    return dictionary.build(dictionary.term_rows(collection(spark, sf_dir), ["place", "subject"], "record_id", "place"))


_ENTRY_ORDER = "row_number() OVER (PARTITION BY lower(term) ORDER BY record_id, c, pos)"


@query("dictionary_entries", f"""WITH {_TERMS} SELECT lower(term) AS key, term, n AS occurrences FROM (SELECT *, {_ENTRY_ORDER} AS rn, count(*) OVER (PARTITION BY lower(term)) AS n FROM term_rows) WHERE rn = 1""")
def dictionary_entries(spark, sf_dir):
    return terms_of(spark, sf_dir).entries.select("key", "term", "occurrences")


@query("dictionary_spellings", f"""WITH {_TERMS}, main AS (SELECT lower(term) AS key, term AS main FROM (SELECT *, {_ENTRY_ORDER} AS rn FROM term_rows) WHERE rn = 1)
SELECT key, term AS spelling, count(*) AS n FROM term_rows JOIN main ON key = lower(term) WHERE term <> main GROUP BY ALL""")
def dictionary_spellings(spark, sf_dir):
    return terms_of(spark, sf_dir).spellings


@query("dictionary_links", f"WITH {_TERMS} SELECT DISTINCT lower(term) AS key, record_id FROM term_rows")
def dictionary_links(spark, sf_dir):
    return terms_of(spark, sf_dir).links


@query("dictionary_from_mentions", f"""WITH {_M} SELECT lower(text) AS key, min_by(text, ord) AS term, count(*) AS occurrences,
  min_by(MAP {{'PER': 'person', 'ORG': 'institution', 'LOC': 'place', 'GPE': 'place', 'CON': 'concept', 'DAT': 'other', 'TOP': 'concept'}}[entity_type], ord) AS entity_type
FROM mentions WHERE status = 'accepted' GROUP BY 1""")
def dictionary_from_mentions(spark, sf_dir):
    return dictionary.from_mentions(mentions(spark, sf_dir)).entries.select("key", "term", "occurrences", "entity_type")


@query("dictionary_merge", f"""WITH {_TERMS}, {_M}, m AS (SELECT lower(text) AS key, min_by(text, ord) AS term, count(*) AS n FROM mentions WHERE status = 'accepted' GROUP BY 1),
main AS (SELECT lower(term) AS key, term, n FROM (SELECT *, {_ENTRY_ORDER} AS rn, count(*) OVER (PARTITION BY lower(term)) AS n FROM term_rows) WHERE rn = 1)
SELECT key, coalesce(main.term, m.term) AS term, coalesce(main.n, 0) + coalesce(m.n, 0) AS occurrences FROM main FULL JOIN m USING (key)""")
def dictionary_merge(spark, sf_dir):
    merged = dictionary.merge(terms_of(spark, sf_dir), dictionary.from_mentions(mentions(spark, sf_dir)))
    return merged.entries.select("key", "term", "occurrences")


@query("dictionary_type_counts", f"""WITH {_M}, e AS (SELECT min_by(MAP {{'PER': 'person', 'ORG': 'institution', 'LOC': 'place', 'GPE': 'place', 'CON': 'concept', 'DAT': 'other', 'TOP': 'concept'}}[entity_type], ord) AS entity_type
FROM mentions WHERE status = 'accepted' GROUP BY lower(text)) SELECT entity_type, count(*) AS n FROM e GROUP BY 1""")
def dictionary_type_counts(spark, sf_dir):
    return dictionary.type_counts(dictionary.from_mentions(mentions(spark, sf_dir)).entries)


@query("dictionary_lookup", f"""WITH {_TERMS} SELECT o_orderkey, e.key FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'BERLIN' WHEN 1 THEN 'Tal' WHEN 2 THEN 'unbekannt' ELSE 'ort ' || (o_custkey % 50) END AS t FROM orders)
LEFT JOIN entries e ON e.key = lower(t)""")
def dictionary_lookup(spark, sf_dir):
    d = terms_of(spark, sf_dir)
    o = inputs.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    texts = o.select("o_orderkey", F.when(k == 0, "BERLIN").when(k == 1, "Tal").when(k == 2, "unbekannt").otherwise(
        F.concat(F.lit("ort "), (F.col("o_custkey") % 50).cast("string"))).alias("t"))
    return dictionary.lookup(texts, "t", d.entries.withColumn("ord", F.col("key")), d.spellings).select("o_orderkey", "key")


@query("dictionary_lookup_ids", """WITH e AS (SELECT p_partkey AS ord, 'k' || p_partkey AS key, CASE WHEN p_size % 5 > 0 THEN 'g' || (p_partkey % 300) ELSE '' END AS gnd_id FROM part),
g AS (SELECT gnd_id, min_by(key, ord) AS key FROM e WHERE gnd_id <> '' GROUP BY 1)
SELECT o_orderkey, g.key AS by_gnd, e.key AS by_entry FROM orders LEFT JOIN g ON g.gnd_id = 'g' || (o_custkey % 400) LEFT JOIN e ON e.key = 'k' || (o_orderkey % 3000)""")
def dictionary_lookup_ids(spark, sf_dir):
    p, o = inputs.table(spark, sf_dir, "part"), inputs.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("k"), "p_partkey")
    entries = p.select(key.alias("key"), key.alias("entry_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("g"), (F.col("p_partkey") % 300).cast("string"))).otherwise("").alias("gnd_id"))
    texts = o.select("o_orderkey", F.concat(F.lit("g"), (F.col("o_custkey") % 400).cast("string")).alias("gnd"), F.concat(F.lit("k"), (F.col("o_orderkey") % 3000).cast("string")).alias("entry"))
    by_gnd = dictionary.lookup_id(texts, "gnd", entries).withColumnRenamed("key", "by_gnd")
    return dictionary.lookup_id(by_gnd, "entry", entries, "entry_id").select("o_orderkey", "by_gnd", F.col("key").alias("by_entry"))


@query("dictionary_target", f"""WITH {_TERMS}, main AS (SELECT lower(term) AS key, term FROM (SELECT *, {_ENTRY_ORDER} AS rn FROM term_rows) WHERE rn = 1)
SELECT key, any_value(main.term) AS term_normalized, min(record_id) AS record_id, 'LOC' AS entity_type, count(DISTINCT t.term) - 1 AS variant_count, '' AS authority_id
FROM main JOIN term_rows t ON lower(t.term) = key GROUP BY key""")
def dictionary_target(spark, sf_dir):
    d = terms_of(spark, sf_dir)
    return dictionary.target_format(d.entries, d.spellings, d.links).select("key", "term_normalized", "record_id", "entity_type", "variant_count", "authority_id")


@query("dictionary_changes", """WITH base AS (SELECT 's' || s_suppkey AS key, s_name AS term, s_nationkey AS n FROM supplier),
raw AS (SELECT 's' || (p_partkey % 30) AS key, CASE (p_partkey // 30 + p_partkey) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op, p_name AS term, p_partkey AS ord FROM part),
ch AS (SELECT * FROM raw WHERE ord % 7 <> 3 OR op <> 'delete'),
line AS (SELECT ch.*, coalesce(last_value(CASE op WHEN 'add' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY ch.key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base.key IS NOT NULL) AS there,
  max(CASE WHEN op = 'delete' THEN ord END) OVER (PARTITION BY ch.key) AS gone FROM ch LEFT JOIN base USING (key)),
live AS (SELECT * FROM line WHERE op <> 'delete' AND (op = 'add') <> there AND (gone IS NULL OR ord > gone)),
last AS (SELECT key, max_by(term, ord) AS term, bool_or(op = 'add') AS made FROM live GROUP BY 1),
dropped AS (SELECT DISTINCT key FROM line WHERE gone IS NOT NULL)
SELECT key, coalesce(last.term, CASE WHEN dropped.key IS NULL THEN base.term END) AS term, CASE WHEN dropped.key IS NULL THEN n END AS n FROM base FULL JOIN last USING (key) LEFT JOIN dropped USING (key)
WHERE (base.key IS NOT NULL AND dropped.key IS NULL) OR coalesce(made, false)""")
def dictionary_changes(spark, sf_dir):
    base = inputs.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("term"), F.col("s_nationkey").alias("n"))
    p = inputs.table(spark, sf_dir, "part")
    kind = (F.floor(F.col("p_partkey") / 30) + F.col("p_partkey")) % 3
    op = F.when(kind == 0, "add").when(kind == 1, "update").otherwise("delete")
    changes = p.where((F.col("p_partkey") % 7 != 3) | (op != "delete")).select(F.concat(F.lit("s"), (F.col("p_partkey") % 30).cast("string")).alias("key"), op.alias("op"), F.col("p_name").alias("term"), F.col("p_partkey").alias("ord"))
    return dictionary.apply_changes(base, changes, "key")[0]


# ---- matching ---------------------------------------------------------------

_NAMES = _A + """, names AS (SELECT name, authority_id, min(r) AS r, any_value(preferred_name) AS preferred_name, any_value(authority_type) AS authority_type, any_value(source) AS source, any_value(ord) AS ord FROM (
SELECT lower(preferred_name) AS name, 0 AS r, * FROM authority UNION ALL
SELECT lower(trim(unnest(string_split(variants, ';')))), 1, * FROM authority) WHERE name <> '' GROUP BY name, authority_id),
wanted AS (SELECT DISTINCT text, entity_type, MAP {'PER': 'Person', 'ORG': 'CorporateBody', 'LOC': 'PlaceOrGeographicName', 'GPE': 'PlaceOrGeographicName', 'CON': 'SubjectHeading'}[entity_type] AS want FROM mentions),
matches AS (SELECT text, entity_type, authority_id, preferred_name, authority_type, source, cast(row_number() OVER (PARTITION BY text, entity_type ORDER BY r, ord) AS INTEGER) AS rank
FROM wanted JOIN names ON name = lower(trim(text)) AND (want IS NULL OR want = authority_type) QUALIFY rank <= 3)"""


def _matches(spark, sf_dir):
    return authority.match_terms(mentions(spark, sf_dir), authorities(spark, sf_dir), 3)


@query("authority_matches", f"WITH {_M}, {_NAMES} SELECT *, cast(greatest(0.2, round(1.0 - (rank - 1) * 0.2, 4)) AS DOUBLE) AS score FROM matches")
def authority_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


_WORDS = "list_sort(list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')))"
_NAME, _TERM = "p_name || ' ' || p_brand || ' ' || p_type", "p_type || ' Nr. ' || (p_size % 7) || ', ' || p_name"


@query("authority_similar", f"""WITH a AS (SELECT 'a' || p_partkey AS authority_id, p_partkey AS ord, {_NAME} AS preferred_name, {_WORDS.format(_NAME)} AS theirs FROM part),
t AS (SELECT DISTINCT {_TERM} AS text, {_WORDS.format(_TERM)} AS ours FROM part),
p AS (SELECT text, authority_id, preferred_name, ord, len(list_intersect(ours, theirs)) AS c, len(ours) + len(theirs) AS n FROM t, a),
r AS (SELECT *, c / (n - c) AS s, cast(row_number() OVER (PARTITION BY text ORDER BY c / (n - c) DESC, ord) AS INTEGER) AS rank FROM p WHERE c / (n - c) >= 0.5)
SELECT text, authority_id, preferred_name, rank, round(s, 4) AS score FROM r WHERE rank <= 3""")
def authority_similar(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    records = part.select(
        F.concat(F.lit("a"), "p_partkey").alias("authority_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("preferred_name"),
        F.array().cast("array<string>").alias("variants"), none.alias("authority_type"), none.alias("source"), F.col("p_partkey").alias("ord"))
    text = F.concat("p_type", F.lit(" Nr. "), (F.col("p_size") % 7).cast("string"), F.lit(", "), "p_name")
    terms = part.select(text.alias("text"), F.lit("TOP").alias("entity_type"))
    return similarity.similar_terms(terms, records, 0.5, 3).select("text", "authority_id", "preferred_name", "rank", "score")


@query("authority_match_counts", f"WITH {_M}, {_NAMES} SELECT (SELECT count(*) FROM wanted) AS total, count(*) FILTER (rank = 1) AS matched, count(*) AS candidates FROM matches")
def authority_match_counts(spark, sf_dir):
    return authority.match_counts(mentions(spark, sf_dir), _matches(spark, sf_dir))


@query("authority_candidates", f"""WITH {_M}, {_NAMES} SELECT text, lower(text) AS entry_id, source, authority_id, cast(greatest(0.3, round(1.0 - (rank - 1) * 0.15, 4)) AS DOUBLE) AS score,
  CASE source WHEN 'gnd' THEN 'https://d-nb.info/gnd/' WHEN 'wikidata' THEN 'https://www.wikidata.org/wiki/' ELSE 'https://www.geonames.org/' END || authority_id AS uri
FROM matches WHERE EXISTS (SELECT 1 FROM mentions m WHERE m.status = 'accepted' AND lower(m.text) = lower(matches.text))""")
def authority_candidates(spark, sf_dir):
    d = dictionary.from_mentions(mentions(spark, sf_dir))
    c = authority.candidates(_matches(spark, sf_dir), d.entries.withColumn("ord", F.col("key")), d.spellings, position=True)
    return c.where("entry_id IS NOT NULL").select("text", "entry_id", "source", "authority_id", "score", "uri")


@query("linked_mentions", f"""WITH {_M}, {_NAMES} SELECT m.ord, coalesce(t.authority_id, m.gnd_id) AS gnd_id, coalesce(t.preferred_name, m.gnd_preferred) AS gnd_preferred
FROM mentions m LEFT JOIN (SELECT * FROM matches WHERE rank = 1) t ON t.text = m.text AND t.entity_type = m.entity_type""")
def linked_mentions(spark, sf_dir):
    return entities.link_matches(mentions(spark, sf_dir), authority.top_matches(_matches(spark, sf_dir))).select("ord", "gnd_id", "gnd_preferred")


@query("authority_result_dedupe", """SELECT event_type, authority_id, ord, cast(row_number() OVER (PARTITION BY event_type ORDER BY ord) AS INTEGER) AS rank FROM (
SELECT event_type, user_id % 20 AS authority_id, min(event_id) AS ord FROM events GROUP BY ALL) QUALIFY rank <= 5""")
def authority_result_dedupe(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("authority_id"), F.col("event_id").alias("ord"))
    return authority.dedupe_results(e, ["event_type"], 5)


@query("committed_authorities", """WITH cand AS (SELECT 'c' || (user_id % 40) AS entry_id, CASE event_id % 3 WHEN 0 THEN 'gnd' WHEN 1 THEN 'wikidata' ELSE 'geonames' END AS source,
  'a' || event_id AS authority_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Name ' || event_id END AS preferred_name,
  CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 'g' || event_id ELSE '' END AS linked, event_id AS ord FROM events WHERE event_type = 'view'),
base AS (SELECT 'c' || c_custkey AS entry_id, CASE WHEN c_custkey % 3 = 0 THEN 'alt' || c_custkey ELSE '' END AS gnd_id FROM customer),
g AS (SELECT entry_id, max_by(authority_id, ord) FILTER (source = 'gnd') AS gid, max_by(authority_id, ord) FILTER (source = 'wikidata') AS wid,
  max_by(authority_id, ord) FILTER (source = 'geonames') AS geo, min_by(linked, ord) FILTER (linked <> '') AS linked, min_by(preferred_name, ord) FILTER (preferred_name <> '') AS nm, count(*) AS n FROM cand GROUP BY 1)
SELECT entry_id, coalesce(nullif(coalesce(gid, gnd_id), ''), linked, '') AS gnd_id, coalesce(wid, '') AS wikidata_id, coalesce(geo, '') AS geonames_id, coalesce(nm, '') AS preferred_name, coalesce(n, 0) AS committed
FROM base LEFT JOIN g USING (entry_id)""")
def committed_authorities(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events").where("event_type = 'view'")
    k = F.col("event_id")
    cand = e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("entry_id"),
        F.when(k % 3 == 0, "gnd").when(k % 3 == 1, "wikidata").otherwise("geonames").alias("source"), F.concat(F.lit("a"), k).alias("authority_id"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Name "), k)).alias("preferred_name"), F.lit("").alias("authority_type"), F.lit("").alias("uri"),
        F.when((k % 3 == 1) & (k % 2 == 0), F.concat(F.lit("g"), k)).otherwise("").alias("linked_gnd_id"), k.alias("ord"), F.lit("accepted").alias("status"),
    )
    c = inputs.table(spark, sf_dir, "customer")
    base = c.select(F.concat(F.lit("c"), "c_custkey").alias("entry_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("alt"), "c_custkey")).otherwise("").alias("gnd_id"))
    return authority.commit_candidates(base, cand).select("entry_id", "gnd_id", "wikidata_id", "geonames_id", "preferred_name", "committed")


@query("dictionary_enrichment", """SELECT count(*) AS total, count(*) FILTER (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS enriched, count(*) FILTER (NOT (c_custkey % 3 = 0 OR c_custkey % 5 = 0)) AS unenriched FROM customer""")
def dictionary_enrichment(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    return authority.enrichment(c.select(F.when(F.col("c_custkey") % 3 == 0, "g").otherwise("").alias("gnd_id"), F.when(F.col("c_custkey") % 5 == 0, "Q1").alias("wikidata_id")))
