"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, documents, folder of the tables) and works on all rows the stage
before it kept. All but the last return the columns of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from collectra.llm import decontaminate, packing, quality, secrets, simhash
from collectra.llm.common import by_crc, table
from collectra.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the discriminant rejects go. It learns from the labelled rows among
    ``docs``, without those that the classifier's query holds out."""
    stats = cut_lineage(quality.features(docs))
    model = quality.learn(stats.where(by_crc(stats, "id", 3) != 1), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: Word hashes, model scores and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
