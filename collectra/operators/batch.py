"""Run a user's function over items: one row in, one answer out."""
from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_text, parse_json, strip
from ..session import cut_lineage, exists
from ..sources.files import list_files
from .joins import lookup_join
from .profile import quoted

#: Steps of a long run, and files of its queue.
MAX_STEPS, MAX_FILES = 100, 4096
RESULT = "success boolean, response string, error string, error_type string, duration double"
Answer = Callable[[list[dict]], list[str]]


def run_items(items: DataFrame, answer: Answer, workers: int | None = None, delay: float = 0.0, size: int = 64) -> DataFrame:
    """Items with the answer, error and duration of each, in any order.

    ``answer`` gets up to ``size`` items as dictionaries. When it fails on a
    group, the group is asked one by one, so one bad item costs only itself.
    ``workers`` bounds the number of parallel callers and ``delay`` pauses each
    of them between calls, which together bound the request rate.
    """
    if workers:
        items = items.repartition(workers)
    names = items.columns

    def ask(group: list[dict]) -> list[tuple]:
        start = time.time()
        try:
            answers = answer(group)
            if len(answers) != len(group):
                raise ValueError(f"{len(answers)} answers for {len(group)} items")
            each = (time.time() - start) / len(group)
            return [(True, a, None, None, each) for a in answers]
        except Exception as e:
            if len(group) == 1:
                return [(False, None, str(e), type(e).__name__, time.time() - start)]
            return [r for item in group for r in ask([item])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, records = [], batch.to_dict("records")
            for i in range(0, len(records), size):
                rows += ask(records[i:i + size])
                if delay:
                    time.sleep(delay)
            out = pd.DataFrame(rows, columns=["success", "response", "error", "error_type", "duration"], index=batch.index)
            yield pd.concat([batch[names], out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInPandas(run, f"{fields}, {RESULT}")


def with_parsed(results: DataFrame) -> DataFrame:
    """Add ``parsed`` (the JSON object or array as text) and ``parse_failed``."""
    parsed = F.to_json(parse_json(F.col("response")))
    return results.withColumn("parsed", parsed).withColumn(
        "parse_failed", F.col("success") & F.col("parsed").isNull() & has_text(strip(F.coalesce("response", F.lit(""))))
    )


def with_item_keys(items: DataFrame, prompt: str = "") -> DataFrame:
    content = F.to_json(F.struct(*[F.col(quoted(c)) for c in items.columns]))
    return items.withColumn("item_key", F.sha2(F.concat_ws("\n", F.lit(prompt), content), 256))


def answer_table(
    items: DataFrame, answer: Answer, prompt: str = "", path: str | None = None, step: int = 256, files: int = 0, workers: int | None = None, **run,
) -> DataFrame:
    """Items with their parsed answers, written once: every later step reads the table,
    so no item is asked twice and all steps see the same answer.

    ``item_key`` is a hash of ``prompt`` and the item. With a ``path`` the answers outlive
    the run, and are committed step by step (:func:`answer_steps`): a run that stops
    keeps what it has paid for up to its last step, and a rerun asks only for
    items whose key has no successful answer there."""
    keyed = with_item_keys(items, prompt)
    if path is None:
        return cut_lineage(with_parsed(run_items(keyed, answer, workers, **run)))
    answer_steps(keyed, answer, path, step, files, workers, **run)
    # a failed item that was asked again has a row for each try; the best one counts
    found = lookup_join(stored_answers(keyed, path), keyed.select("item_key").distinct(), "item_key", "left_semi")
    best = found.groupBy("item_key").agg(F.max(F.col("success").cast("int")).alias("_best"))
    return found.join(best, "item_key").where(F.col("success").cast("int") == F.col("_best")).drop("_best").select(
        *keyed.columns, *[c for c in found.columns if c not in keyed.columns])


def stored_answers(keyed: DataFrame, path: str) -> DataFrame:
    """All answers below ``path``, in the columns of keyed items; none where nothing is stored."""
    spark = keyed.sparkSession
    schema = T.StructType([*keyed.schema.fields, *T.StructType.fromDDL(f"{RESULT}, parsed string, parse_failed boolean").fields])
    folder = f"{path.rstrip('/')}/answers"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    # step folders are only names: without this they would add columns
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def answer_steps(keyed: DataFrame, answer: Answer, path: str, step: int = 256, files: int = 0, workers: int | None = None, **run) -> None:
    """Ask for the items that have no successful answer below ``path``, in steps.

    The open items are written as files of at most ``step`` rows and read back as a stream of
    ``files`` (as many as there are cores, unless given) at a time. Each micro-batch writes its
    answers to a folder named after run and batch, so what a batch has finished is
    committed whatever becomes of the next, and a batch that is tried again replaces
    its own rows. Within a batch each task commits its own file, so a batch that fails keeps its
    finished tasks. A step costs about a second whatever it holds: a run of more than ``MAX_STEPS`` takes longer steps,
    and more than ``MAX_FILES`` files become larger ones. When a run stops, it loses one batch of answers at most:
    ``files`` times ``step`` items, or about a hundredth of a long run."""
    spark = keyed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    name, root = uuid.uuid4().hex[:12], path.rstrip("/")
    todo = cut_lineage(pending_items(keyed, stored_answers(keyed, path).where("success").select("item_key"), ["item_key"]))
    queue = f"{root}/queue/{name}"
    todo.write.option("maxRecordsPerFile", max(step, ceil(todo.count() / MAX_FILES))).parquet(queue)
    at_once = max(files or cores, ceil(len(list_files(spark, queue)) / MAX_STEPS))

    def commit(batch: DataFrame, number: int) -> None:
        done = with_parsed(run_items(batch, answer, workers or cores, **run))
        done.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{root}/answers/{name}/{number}")

    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", at_once).parquet(queue)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{root}/progress/{name}").trigger(availableNow=True).start().awaitTermination()


def pending_items(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items a stopped run still has to answer."""
    return lookup_join(items, done.select(*keys).distinct(), keys, "left_anti")


def batch_report(parsed: DataFrame) -> DataFrame:
    ok = F.col("success")
    return parsed.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if("parse_failed").alias("parse_failed"),
        F.coalesce(F.avg(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("avg_duration"),
    ).withColumn("success_rate", F.when(F.col("total") > 0, F.col("succeeded") / F.col("total")).otherwise(0.0))


def parse_failures(parsed: DataFrame) -> DataFrame:
    preview = F.when(F.length("response") > 200, F.concat(F.substring("response", 1, 200), F.lit("..."))).otherwise(F.col("response"))
    return parsed.where("parse_failed").select("record_id", preview.alias("raw_response_preview"), F.lit("JSON parse failed").alias("error_message"))


def completion_summary(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """Records with results, failures and empty answers of an extraction run.
    ``found`` are the extracted rows; a record counts once however many it has."""
    records = found.select("record_id").distinct().withColumn("_found", F.lit(True))
    marked = lookup_join(parsed, records, ["record_id"], "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    base = marked.agg(
        F.count("*").alias("total_records"), F.count_if(~F.col("success")).alias("llm_failed"), F.count_if("parse_failed").alias("parse_failed"),
        F.count_if(F.col("success") & F.col("parsed").isNotNull() & ~F.col("_found")).alias("empty_result"),
    )
    both = base.unionByName(records.agg(F.count("*").alias("succeeded")), allowMissingColumns=True)
    return merge_summaries(both.fillna(0))


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One summary of many chunks."""
    names = ["total_records", "succeeded", "llm_failed", "parse_failed", "empty_result"]
    rate = F.when(F.col("total_records") > 0, F.col("succeeded") / F.col("total_records")).otherwise(0.0)
    return summaries.agg(*[F.sum(n).alias(n) for n in names]).withColumns({
        "completion_rate": F.round(rate, 4), "completion_percentage": F.bround(rate * 100).cast("int")
    })


def run_log(runs: DataFrame) -> DataFrame:
    """Runs, rows, errors and chunks per task."""
    return runs.groupBy("task").agg(
        F.count("*").alias("runs"), F.sum("processed_rows").alias("rows"), F.sum("error_rows").alias("errors"), F.sum("chunk_count").alias("chunks")
    )
