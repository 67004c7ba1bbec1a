"""Process files as they arrive, a bounded number per batch."""
from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Process = Callable[[DataFrame], DataFrame]
METRICS = "batch_id long, rows long, results long, error string, finished_at string"

# Signs of an error that is not the batch's own.
CLUSTER_ERRORS = ("ExecutorLostFailure", "FetchFailed", "SparkContext was shut down", "has been stopped", "OutOfMemoryError", "No space left on device", "Connection refused")


def run_incremental(
    spark: SparkSession, source: str, schema, process: Process, out: str, files_per_batch: int = 100, source_format: str = "parquet",
    task: str = "run",
) -> DataFrame:
    """Run ``process`` over every file not seen yet and return the run record.

    Each batch writes its results and metrics to a folder named after its id,
    replacing what a failed attempt left, so a rerun neither loses nor doubles
    rows. An error in ``process`` is recorded for its batch, whose rows are set aside
    below ``out/rejects``, and does not stop the others; an error of the cluster ends
    the run, and the batch is taken again by the next call. Progress is kept below ``out``; the next call goes on from there.
    """
    stream = spark.readStream.format(source_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        target = os.path.join(out, "results", f"batch_id={batch_id}")
        rows, written, error = batch.count(), 0, None
        try:
            process(batch).write.mode("overwrite").parquet(target)
            written = session.read.parquet(target).count()
        except Exception as e:
            if any(sign in str(e) for sign in CLUSTER_ERRORS):
                raise
            error = f"{type(e).__name__}: {e}"[:2000]
            batch.write.mode("overwrite").parquet(os.path.join(out, "rejects", f"batch_id={batch_id}"))
        now = datetime.now(timezone.utc).isoformat()
        record = session.createDataFrame([(batch_id, rows, written, error, now)], METRICS)
        record.write.mode("overwrite").parquet(os.path.join(out, "metrics", f"batch_id={batch_id}"))

    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", os.path.join(out, "progress"))
        .trigger(availableNow=True).queryName(task).start()
    )
    query.awaitTermination()
    return run_record(spark, out, task)


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, "results"))


def run_record(spark: SparkSession, out: str, task: str = "run") -> DataFrame:
    """One row: chunks, rows, results and failed rows of all batches so far."""
    batches = spark.read.schema(METRICS).parquet(os.path.join(out, "metrics"))
    return batches.agg(
        F.count("*").alias("chunk_count"), F.sum("rows").alias("processed_rows"), F.sum("results").alias("result_rows"),
        F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("rows"))), F.lit(0)).alias("error_rows"),
    ).withColumn("task", F.lit(task))


class Progress(StreamingQueryListener):
    """Passes the row count of each finished batch to a callback."""

    def __init__(self, report: Callable[[int, int], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.report(event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        pass
