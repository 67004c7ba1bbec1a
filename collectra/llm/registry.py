"""Queries of this subpackage by name, and SQL where it can say the same."""
from __future__ import annotations

import corpus_pipeline

from . import bpe, collocations, decontaminate, extract, middle, packing, quality, scoring, secrets, simhash, substrings, urls, vectors


def queries() -> dict:
    return {
        "op1_lm_scoring": scoring.op1,
        "op2_substring_dedup": substrings.op2,
        "op3_url_filter": urls.op3,
        "op4_html_extraction": extract.op4,
        "op5_quality_classifier": quality.op5,
        "op6_secret_scans": secrets.op6,
        "op7_benchmark_decontamination": decontaminate.op7,
        "op8_simhash_near_dedup": simhash.op8,
        "op9_embedding_near_dedup": vectors.op9,
        "op10_best_fit_packing": packing.op10,
        "op11_phrase_collocations": collocations.op11,
        "op12_fill_in_middle": middle.op12,
        "op13_byte_bpe": bpe.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substrings.OP2_SQL,
        "op9_embedding_near_dedup": vectors.OP9_SQL,
        "op11_phrase_collocations": collocations.OP11_SQL,
        "op12_fill_in_middle": middle.OP12_SQL,
    }
