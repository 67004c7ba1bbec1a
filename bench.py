"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (comma separated, or ``all``) the queries.
"""
from __future__ import annotations

import json
import os
import statistics
import time

from collectra.plans import registry
from collectra.session import build_session

HEADLINE = [
    "column_profile", "value_frequencies", "findings", "quality_measures", "check_linkage", "date_normalization", "term_scan_words",
    "term_scan_substrings", "term_scan_documents", "facet_counts", "sample_stratified", "unique_mentions", "merged_extractions",
    "dictionary_entries", "authority_matches", "corrected_records", "enriched_entities", "import_xml_records", "jsonld_records",
    "csv_load", "mods_load", "model_mentions", "incremental_dates",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def run(fn, spark, sf_dir) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    times = {}
    for name in names:
        run(queries[name], spark, sf_dir)  # warm up: class loading and code generation
        times[name] = round(statistics.median(run(queries[name], spark, sf_dir) for _ in range(REPEATS)), 3)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
