"""Profiling, checks, measures and report levels on the derived collection."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs
from ..functions.codes import scope_of
from ..functions.text import clean_cell
from ..operators import checks, measures, profile, report
from ..session import cut_lineage
from .registry import query

WIDE = [
    "record_id", "named_entity_1", "named_entity_1_gnd_id", "named_entity_1_gnd_preferredName", "named_entity_1_gnd_type",
    "named_entity_1_gnd_konfidenz", "named_entity_1_gnd_alternativen", "named_entity_1_gnd_begruendung", "named_entity_2",
    "named_entity_2_gnd_id", "named_entity_2_gnd_preferredName", "named_entity_2_gnd_type", "named_entity_2_gnd_konfidenz",
    "named_entity_2_gnd_alternativen", "named_entity_2_gnd_begruendung",
]
COLUMNS = ["record_id", "title", "creator", "place", "subject", "date_text", "note"]


def collection(spark, sf_dir):
    raw = inputs.derive(spark, sf_dir, "collection_raw")
    return raw.select(*[clean_cell(F.col(c)).alias(c) for c in raw.columns])


def datasets(spark, sf_dir):
    wide = inputs.derive(spark, sf_dir, "wide_ne").select(*WIDE)
    return [
        profile.Dataset("collection", collection(spark, sf_dir), "record_id"),
        profile.Dataset("holdings", wide, "record_id", has_bom=True, line_ending="CRLF"),
    ]


# ---- DuckDB forms -----------------------------------------------------------

def clean_sql(c: str) -> str:
    s = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {s} IN ('', 'nan', 'NaN', 'NULL', 'None', 'N/A', 'n/a') THEN NULL ELSE {s} END AS {c}"


COLLECTION = inputs.cte("collection_raw") + ", collection AS (SELECT " + ", ".join(clean_sql(c) for c in COLUMNS) + " FROM collection_raw)"
HOLDINGS = inputs.cte("wide_ne") + ", holdings AS (SELECT " + ", ".join(f'"{c}"' for c in WIDE) + " FROM wide_ne)"


def cells_sql(table: str, columns: list[str]) -> str:
    parts = [f"SELECT '{table}' AS dataset, record_id, '{c}' AS \"column\", \"{c}\" AS value FROM {table}" for c in columns]
    return " UNION ALL ".join(parts)


CELLS = f"{COLLECTION}, {HOLDINGS}, cells AS ({cells_sql('collection', COLUMNS)} UNION ALL {cells_sql('holdings', WIDE)})"
FREQ = CELLS + ', freq AS (SELECT dataset, "column", value, count(*) AS cnt FROM cells GROUP BY ALL)'
PROFILE = FREQ + """, profile AS (
SELECT dataset, "column", cast(sum(cnt) AS BIGINT) AS total_count,
  cast(coalesce(sum(cnt) FILTER (value IS NOT NULL), 0) AS BIGINT) AS non_null_count, count(value) AS unique_count,
  min(length(value)) AS min_length, max(length(value)) AS max_length,
  cast(floor(cast(sum(length(value) * cnt) AS DOUBLE) / sum(cnt) FILTER (value IS NOT NULL)) AS INTEGER) AS mean_length
FROM freq GROUP BY ALL)"""


def ids_sql(n: int) -> str:
    return f"coalesce(array_to_string(list_slice(list_sort(list(record_id) FILTER (record_id IS NOT NULL)), 1, {n}), ','), '')"


TERMS = """CASE WHEN contains(value, ';') THEN string_split(value, ';') WHEN contains(value, '|') THEN string_split(value, '|') ELSE [value] END"""
VARIANTS = """, spelled AS (
SELECT dataset, "column", lower(form) AS canonical, form, cast(sum(cnt) AS BIGINT) AS cnt FROM (
  SELECT dataset, "column", cnt, regexp_replace(unnest(TERMS), '^\\s+|\\s+$', '', 'g') AS form
  FROM freq WHERE value IS NOT NULL AND value <> '') WHERE form <> '' GROUP BY ALL),
variants AS (
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dataset, "column", canonical) AS forms FROM spelled) WHERE forms > 1)""".replace("TERMS", TERMS)

LINKS = """, members AS (
SELECT record_id, max(CASE WHEN d = 'collection' THEN 1 ELSE 0 END) AS a, max(CASE WHEN d = 'holdings' THEN 1 ELSE 0 END) AS b
FROM (SELECT 'collection' AS d, record_id FROM collection UNION ALL SELECT 'holdings', record_id FROM holdings) WHERE record_id IS NOT NULL GROUP BY 1)"""

FINDINGS = PROFILE + VARIANTS + LINKS + f""", gaps AS (
SELECT *, round(non_null_count / total_count, 4) AS rate FROM profile WHERE 1.0 - round(non_null_count / total_count, 4) <> 0),
repeats AS (SELECT dataset, record_id, sum(cnt) AS cnt FROM (SELECT dataset, record_id, 1 AS cnt FROM cells WHERE "column" = 'record_id') GROUP BY ALL HAVING count(*) > 1),
findings AS (
SELECT g.dataset, 'missing_values' AS category,
  CASE WHEN 1.0 - rate >= 0.95 THEN 'info' WHEN 1.0 - rate >= 0.1 THEN 'warning' ELSE 'info' END AS severity,
  g."column", '' AS pattern, total_count - non_null_count AS n, any_value(ids) AS ids, 0 AS suggested, rate AS coverage
FROM gaps g JOIN (SELECT dataset, "column", {ids_sql(10)} AS ids FROM cells WHERE value IS NULL OR value = '' GROUP BY ALL) m
  ON g.dataset = m.dataset AND g."column" = m."column" GROUP BY g.dataset, g."column", rate, total_count, non_null_count
UNION ALL
SELECT dataset, 'duplicate_records', 'critical', 'record_id', '', cast(sum(cnt) AS BIGINT), {ids_sql(20)}, 0, NULL FROM repeats GROUP BY dataset
UNION ALL
SELECT dataset, 'encoding_issues', 'warning', "column", p, count(*), {ids_sql(5)}, 0, NULL
FROM cells, (SELECT unnest(['Ã¤', 'Ã¶', 'Ã¼', 'Â']) AS p) WHERE contains(value, p) GROUP BY dataset, "column", p
UNION ALL
SELECT 'holdings', 'encoding_issues', 'info', '', '', NULL, '', 0, NULL FROM range(2)
UNION ALL
SELECT dataset, 'format_inconsistency', 'warning', "column", 'both_rows', count(*), {ids_sql(5)}, 0, NULL
FROM cells WHERE contains(value, ';') AND contains(value, ',') GROUP BY dataset, "column"
UNION ALL
SELECT dataset, 'format_inconsistency', 'warning', "column", 'whitespace_count', count(*), {ids_sql(5)}, 0, NULL
FROM cells WHERE value <> '' AND regexp_matches(value, '^\\s|\\s$') GROUP BY dataset, "column"
UNION ALL
SELECT dataset, 'term_variants', 'warning', "column", '', count(DISTINCT canonical), '', 1, NULL FROM variants GROUP BY dataset, "column"
UNION ALL
SELECT 'holdings', 'gnd_match_missing', CASE WHEN f / t < 0.5 THEN 'warning' ELSE 'info' END, '', '', nm, '', 1, round(f / t, 4)
FROM (SELECT count(*) AS t, count(*) FILTER (value <> '') AS f FROM cells WHERE dataset = 'holdings' AND contains(lower("column"), 'gnd_id')),
     (SELECT count(*) FILTER (contains(lower(value), 'kein gnd-match')) AS nm FROM cells WHERE dataset = 'holdings' AND contains(lower("column"), 'begruendung'))
UNION ALL
SELECT 'collection', 'orphan_records', 'warning', '', '', count(*), {ids_sql(10)}, 0, NULL FROM members WHERE a = 1 AND b = 0
UNION ALL
SELECT 'holdings', 'orphan_records', 'warning', '', '', count(*), {ids_sql(10)}, 0, NULL FROM members WHERE a = 0 AND b = 1
UNION ALL
SELECT 'collection', 'cross_file_mismatch', 'info', '', '', count(*), '', 0, NULL FROM members WHERE a = 1 AND b = 1)"""


# ---- queries ----------------------------------------------------------------

def _findings(spark, sf_dir):
    """Findings are report-sized: written once, so that no level rescans the data."""
    return cut_lineage(checks.run_checks(datasets(spark, sf_dir)))


def _profile(spark, sf_dir):
    return checks.profiles(datasets(spark, sf_dir))


@query("column_profile", f"WITH {PROFILE} SELECT *, non_null_count / total_count AS fill_rate FROM profile")
def column_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query("column_samples", f"""WITH {FREQ}
SELECT "column", value, cast(row_number() OVER (PARTITION BY "column" ORDER BY value) AS INTEGER) AS pos
FROM freq WHERE dataset = 'collection' AND value IS NOT NULL QUALIFY pos <= 3""")
def column_samples(spark, sf_dir):
    return profile.sample_values(collection(spark, sf_dir))


_DOCS = "SELECT unnest(['text', 'lang', 'source']) AS \"column\", unnest([text, lang, source]) AS value FROM documents"


@query("long_text_profile", f"""WITH c AS ({_DOCS}) SELECT "column", count(*) AS total_count, count(value) AS non_null_count, count(DISTINCT value) AS unique_count, cast(min(length(value)) AS INTEGER) AS min_length,
  cast(max(length(value)) AS INTEGER) AS max_length, count(value) / count(*) AS fill_rate, cast(floor(sum(length(value)) / count(value)) AS INTEGER) AS mean_length FROM c GROUP BY 1""")
def long_text_profile(spark, sf_dir):
    return profile.column_profile(profile.value_counts(inputs.table(spark, sf_dir, "documents").select("text", "lang", "source")))


@query("long_text_samples", f"""WITH c AS (SELECT DISTINCT * FROM ({_DOCS})) SELECT "column", value, cast(row_number() OVER (PARTITION BY "column" ORDER BY value) AS INTEGER) AS pos FROM c WHERE value IS NOT NULL QUALIFY pos <= 3""")
def long_text_samples(spark, sf_dir):
    return profile.sample_values(inputs.table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("long_text_variants", """WITH w AS (SELECT trim(unnest(string_split(replace(replace(text, ';', ' '), ' ', ';'), ';')), chr(9) || chr(10) || chr(13) || ' ') AS form FROM documents WHERE contains(text, ' ')),
f AS (SELECT form, lower(form) AS canonical, count(*) AS cnt FROM w WHERE form <> '' GROUP BY ALL)
SELECT 'text' AS "column", canonical, form, cnt, count(*) OVER (PARTITION BY canonical) AS forms FROM f QUALIFY forms > 1""")
def long_text_variants(spark, sf_dir):
    """Every word of every document as a term of one long cell."""
    docs = inputs.table(spark, sf_dir, "documents").where(F.col("text").contains(" "))
    words = docs.select(F.translate(F.translate("text", ";", " "), " ", ";").alias("text"))
    ds = profile.Dataset("documents", words, None)
    counts = cut_lineage(checks.counts_of(ds))
    return checks.variant_rows(checks.variant_groups(counts, checks.long_values(ds, counts)))


@query("fill_rates", f"""WITH {CELLS}
SELECT "column", count(*) AS total_count, count(value) AS filled_count, count(value) / count(*) AS fill_rate
FROM cells WHERE dataset = 'collection' GROUP BY 1""")
def fill_rates(spark, sf_dir):
    return profile.fill_rates(collection(spark, sf_dir))


@query("value_frequencies", f"""WITH {FREQ} SELECT "column", value, cnt FROM freq WHERE dataset = 'collection'""")
def value_frequencies(spark, sf_dir):
    return profile.frequencies(collection(spark, sf_dir))


@query("id_candidates", """
SELECT "column", CASE WHEN "column" = 'id' THEN 2 ELSE 1000 + pos END AS rank, u AS unique_count FROM (
  SELECT 'id' AS "column", 1 AS pos, count(DISTINCT o_orderkey) AS u, count(o_orderkey) AS c FROM orders
  UNION ALL SELECT 'custkey', 2, count(DISTINCT o_custkey), count(o_custkey) FROM orders
  UNION ALL SELECT 'price_key', 3, count(DISTINCT o_orderkey || ':' || o_custkey), count(*) FROM orders
  UNION ALL SELECT 'status', 4, count(DISTINCT o_orderstatus), count(*) FROM orders) WHERE u = c""")
def id_candidates(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    df = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey"),
        F.concat_ws(":", "o_orderkey", "o_custkey").alias("price_key"), F.col("o_orderstatus").alias("status"),
    )
    return profile.id_candidates(profile.column_profile(profile.value_counts(df)), df.columns)


@query("id_uniqueness", f"""WITH {COLLECTION}
SELECT count(*) AS row_count, count(record_id) AS value_count, count(DISTINCT record_id) AS distinct_count,
  count(record_id) = count(DISTINCT record_id) AS is_unique FROM collection""")
def id_uniqueness(spark, sf_dir):
    return profile.id_uniqueness(profile.use_record_id(collection(spark, sf_dir), "record_id"), "record_id")


@query("duplicate_rows", f"""WITH {COLLECTION}
SELECT record_id, title, n FROM (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM collection) WHERE n > 1""")
def duplicate_rows(spark, sf_dir):
    return checks.duplicate_rows(collection(spark, sf_dir).select("record_id", "title"), "record_id")


def flat_findings(df):
    first = ["missing_count", "duplicate_row_count", "orphan_count", "count", "both_rows", "whitespace_count", "variant_count"]
    e = {k: F.try_element_at(F.col("evidence"), F.lit(k)) for k in [*first, "no_match_count", "shared_count", "coverage_rate", "fill_rate"]}
    return df.select(
        "dataset", "category", "severity", F.coalesce("column", F.lit("")).alias("column"), F.coalesce("pattern", F.lit("")).alias("pattern"),
        F.coalesce(*[e[k] for k in first], e["no_match_count"], e["shared_count"]).cast("long").alias("n"),
        F.concat_ws(",", "record_ids").alias("ids"), F.when(F.col("suggestion").isNotNull(), 1).otherwise(0).alias("suggested"),
        F.coalesce(e["coverage_rate"], e["fill_rate"]).alias("coverage"),
    )


@query("findings", f"WITH {FINDINGS} SELECT * FROM findings")
def findings(spark, sf_dir):
    return flat_findings(_findings(spark, sf_dir))


def _one_check(name, check, category):
    @query(f"check_{name}", f"WITH {FINDINGS} SELECT * FROM findings WHERE category = '{category}'")
    def run(spark, sf_dir):
        a, b = datasets(spark, sf_dir)
        return flat_findings(check(a).unionByName(check(b)))

    return run


_one_check("missing_values", checks.check_missing_values, "missing_values")
_one_check("duplicate_records", checks.check_duplicate_records, "duplicate_records")
_one_check("encoding", checks.check_encoding_issues, "encoding_issues")
_one_check("format", checks.check_format_inconsistency, "format_inconsistency")
_one_check("term_variants", checks.check_term_variants, "term_variants")
_one_check("authority_coverage", checks.check_authority_coverage, "gnd_match_missing")


@query("check_linkage", f"WITH {FINDINGS} SELECT * FROM findings WHERE category IN ('orphan_records', 'cross_file_mismatch')")
def check_linkage(spark, sf_dir):
    return flat_findings(checks.check_linkage(datasets(spark, sf_dir)))


@query("term_variant_groups", f"""WITH {FREQ} {VARIANTS}
SELECT "column", canonical, form, cnt, forms FROM variants WHERE dataset = 'collection'""")
def term_variant_groups(spark, sf_dir):
    return checks.variant_rows(checks.variant_groups(profile.frequencies(collection(spark, sf_dir))))


@query("authority_slots", f"""WITH {CELLS} SELECT
  count(*) FILTER (contains(lower("column"), 'gnd_id')) AS total_ne_slots,
  count(*) FILTER (contains(lower("column"), 'gnd_id') AND value <> '') AS filled_gnd_ids,
  count(*) FILTER (contains("column", 'begruendung') AND contains(lower(value), 'kein gnd-match')) AS no_match_count,
  count(*) FILTER (contains("column", 'begruendung') AND contains(lower(value), 'api-abfrage empfohlen')) AS api_recommended
FROM cells WHERE dataset = 'holdings'""")
def authority_slots(spark, sf_dir):
    return checks.authority_coverage(datasets(spark, sf_dir)[1].df)


_DOCS = """, docs AS (SELECT 'documents' AS d, doc_id AS k FROM documents UNION ALL SELECT 'labels', doc_id FROM labels)"""


@query("linkage_counts", """
WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT 'documents' AS a, 'labels' AS b, (SELECT count(*) FROM d JOIN l USING (doc_id)) AS shared_count,
  (SELECT count(*) FROM d ANTI JOIN l USING (doc_id)) AS only_in_a, (SELECT count(*) FROM l ANTI JOIN d USING (doc_id)) AS only_in_b""")
def linkage_counts(spark, sf_dir):
    return checks.linkage_counts([profile.Dataset(t, inputs.table(spark, sf_dir, t), "doc_id") for t in ("documents", "labels")])


@query("linkage_orphans", """
SELECT 'orders' AS source, 'lineitem' AS target, cast(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'lineitem', 'orders', cast(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def linkage_orphans(spark, sf_dir):
    a = profile.Dataset("orders", inputs.table(spark, sf_dir, "orders"), "o_orderkey")
    b = profile.Dataset("lineitem", inputs.table(spark, sf_dir, "lineitem"), "l_orderkey")
    return checks.orphans([a, b])


FACTS = FINDINGS + """, facts AS (SELECT
  (SELECT bround_avg FROM (SELECT sum(round(non_null_count / total_count, 4)) / count(*) AS bround_avg FROM profile)) AS mean_rate,
  (SELECT sum(r) FROM (SELECT max(total_count) AS r FROM profile GROUP BY dataset)) AS n_records,
  count(*) AS nf, count(*) FILTER (severity = 'critical') AS ncrit, count(*) FILTER (severity = 'warning') AS nwarn, sum(suggested) AS nsug,
  sum(n) FILTER (category = 'missing_values') AS missing, sum(n) FILTER (category = 'duplicate_records') AS dups,
  sum(CASE severity WHEN 'critical' THEN 20 WHEN 'warning' THEN 10 ELSE 3 END) FILTER (category IN ('encoding_issues', 'format_inconsistency', 'schema_mismatch')) AS pen,
  count(*) FILTER (category IN ('encoding_issues', 'format_inconsistency', 'schema_mismatch')) AS nstruct,
  sum(n) FILTER (category = 'term_variants') AS variants, count(*) FILTER (category = 'format_inconsistency') AS nfmt,
  max(coverage) FILTER (category = 'gnd_match_missing') AS cov, sum(n) FILTER (category = 'gnd_match_missing') AS nomatch,
  sum(n) FILTER (category = 'orphan_records') AS orphans, count(*) FILTER (category = 'orphan_records') AS norphan
FROM findings), scored AS (
SELECT 'completeness' AS measure, round_even(mean_rate * 100, 0) AS score, missing AS evidence_count FROM facts
UNION ALL SELECT 'uniqueness', greatest(0, round_even(100 - cast(dups AS DOUBLE) / n_records * 100, 0)), dups FROM facts
UNION ALL SELECT 'structural_validity', greatest(0, 100 - pen), nstruct FROM facts
UNION ALL SELECT 'consistency', 100 - least(80, variants * 5 + 10), variants + nfmt FROM facts
UNION ALL SELECT 'semantic_correctness', 75, 0
UNION ALL SELECT 'normalization', greatest(0, round_even(cov * 100, 0) - least(30, variants * 3)), variants + nomatch FROM facts
UNION ALL SELECT 'clarity', 80, 0
UNION ALL SELECT 'cross_field_coherence', 100 - least(80, norphan * 10), orphans FROM facts
UNION ALL SELECT 'provenance', greatest(0, round_even(cov * 100, 0)), nomatch FROM facts
UNION ALL SELECT 'risk_severity', least(49, greatest(0, round_even(100 - ncrit / nf * 80 - nwarn / nf * 30, 0))), ncrit + nwarn FROM facts
UNION ALL SELECT 'actionability', round_even(nsug / nf * 100, 0), nsug FROM facts),
measures AS (SELECT * FROM scored UNION ALL
SELECT 'fitness_for_use', round_even(avg(score), 0), 0 FROM scored WHERE measure IN ('completeness', 'uniqueness', 'structural_validity'))"""


@query("quality_measures", f"""WITH {FACTS}
SELECT measure, cast(score AS INTEGER) AS score, cast(evidence_count AS BIGINT) AS evidence_count,
  CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'needs_review' ELSE 'critical' END AS status FROM measures""")
def quality_measures(spark, sf_dir):
    return measures.quality_measures(*checks.analyze(datasets(spark, sf_dir))).select("measure", "score", "status", "evidence_count")


@query("measure_examples", f"""WITH {FINDINGS}
SELECT "column", n AS missing_count, cast(row_number() OVER (ORDER BY n DESC) AS INTEGER) AS pos
FROM findings WHERE category = 'missing_values' AND dataset = 'collection' QUALIFY pos <= 3""")
def measure_examples(spark, sf_dir):
    found = checks.check_missing_values(datasets(spark, sf_dir)[0])
    return measures.measure_examples(found).where("measure = 'completeness'").select(
        "column", F.col("evidence")["missing_count"].cast("long").alias("missing_count"), "pos"
    )


@query("analysis_summary", f"""WITH {FACTS}
SELECT nf AS total_findings, ncrit AS critical, nwarn AS warnings, nf - ncrit - nwarn AS info, cast(2 AS BIGINT) AS datasets_analyzed,
  cast(n_records AS BIGINT) AS total_records, (SELECT count(*) FROM profile) AS total_columns FROM facts""")
def analysis_summary(spark, sf_dir):
    return report.summary(*checks.analyze(datasets(spark, sf_dir)))


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


@query("column_reports", f"""WITH {FINDINGS}
SELECT p.dataset AS source, p."column", cast(round_even(round(non_null_count / total_count, 4) * 100, 0) AS INTEGER) AS completeness,
  unique_count, coalesce(worst < 2, false) AS review_required
FROM profile p LEFT JOIN (SELECT "column", min({_RANK}) AS worst FROM findings WHERE "column" <> '' GROUP BY 1) f USING ("column")""")
def column_reports(spark, sf_dir):
    return report.column_reports(*checks.analyze(datasets(spark, sf_dir))).select(
        "source", "column", "completeness", "unique_count", "review_required"
    )


_LISTED = f", listed AS (SELECT *, unnest(string_split(ids, ',')) AS record_id FROM findings WHERE ids <> '')"


@query("record_reports", f"""WITH {FINDINGS} {_LISTED}
SELECT record_id, ['critical', 'warning', 'info'][min({_RANK}) + 1] AS severity, count(*) AS n_issues, min({_RANK}) < 2 AS review_required
FROM listed GROUP BY record_id""")
def record_reports(spark, sf_dir):
    reports = report.record_reports(_findings(spark, sf_dir))
    return reports.select("record_id", "severity", F.size("issues").cast("long").alias("n_issues"), "review_required")


_CLUSTERS = f""", clusters AS (
SELECT category, min({_RANK}) AS worst, array_to_string(list_sort(list_distinct(list("column") FILTER ("column" <> ''))), ',') AS affected_columns,
  CASE WHEN bool_or(category IN ('missing_values', 'duplicate_records', 'orphan_records', 'gnd_match_missing')) THEN cast(sum(n) AS BIGINT)
    ELSE (SELECT count(DISTINCT record_id) FROM listed l WHERE l.category = f.category) END AS affected_records
FROM findings f GROUP BY category), numbered AS (
SELECT *, 'cluster_' || lpad(cast(row_number() OVER (ORDER BY worst, category) - 1 AS VARCHAR), 3, '0') || '_' || category AS cluster_id,
  ['critical', 'warning', 'info'][worst + 1] AS severity FROM clusters)"""


@query("issue_clusters", f"""WITH {FINDINGS} {_LISTED} {_CLUSTERS}
SELECT cluster_id, category, coalesce(affected_columns, '') AS affected_columns, affected_records, severity FROM numbered""")
def issue_clusters(spark, sf_dir):
    c = report.issue_clusters(_findings(spark, sf_dir))
    return c.select("cluster_id", "category", F.concat_ws(",", "affected_columns").alias("affected_columns"), "affected_records", "severity")


@query("work_package_candidates", f"""WITH {FINDINGS} {_LISTED} {_CLUSTERS}
SELECT category AS action_type, severity AS priority, affected_records AS estimated_records, coalesce(affected_columns, '') AS affected_columns FROM numbered WHERE severity <> 'info'""")
def work_package_candidates(spark, sf_dir):
    p = report.package_candidates(report.issue_clusters(_findings(spark, sf_dir)))
    return p.select("action_type", "priority", "estimated_records", F.concat_ws(",", "affected_columns").alias("affected_columns"))


@query("cell_findings", f"""WITH {FINDINGS}
SELECT category, "column", ids AS record_id, severity FROM findings WHERE "column" <> '' AND ids <> '' AND NOT contains(ids, ',')""")
def cell_findings(spark, sf_dir):
    return report.cell_findings(_findings(spark, sf_dir)).select("category", "column", "record_id", "severity")


@query("finding_scopes", f"""WITH {FINDINGS}
SELECT category, CASE WHEN ids = '' THEN 'dataset-level' WHEN NOT contains(ids, ',') THEN 'single-record'
  ELSE cast(length(ids) - length(replace(ids, ',', '')) + 1 AS VARCHAR) || ' records' END AS scope, count(*) AS n FROM findings GROUP BY ALL""")
def finding_scopes(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.groupBy("category", scope_of(F.size("record_ids")).alias("scope")).agg(F.count("*").alias("n"))


@query("report_tables", f"""WITH {FINDINGS}
SELECT 'findings_by_severity' AS report_table, NULL AS category, severity, count(*) AS n FROM findings GROUP BY severity
UNION ALL SELECT 'findings_by_category', category, severity, count(*) FROM findings GROUP BY category, severity""")
def report_tables(spark, sf_dir):
    return report.combined(report.report_tables(_findings(spark, sf_dir)))


@query("facet_columns", f"""WITH {FREQ}
SELECT "column", count(*) AS distinct_values, cast(sum(cnt) AS BIGINT) AS non_empty,
  CASE WHEN count(*) <= 40 AND count(*) < sum(cnt) THEN 'facet' ELSE 'text' END AS kind
FROM freq WHERE dataset = 'collection' AND value <> '' GROUP BY 1""")
def facet_columns(spark, sf_dir):
    return profile.facet_columns(profile.value_counts(collection(spark, sf_dir)))
