"""Quality classifier: regularised quadratic discriminant over document statistics."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blobs, by_crc, table, texts

FEATURES = ["words", "word_length", "upper", "digits", "symbols", "marks", "stops", "beyond_ascii", "variety", "line_variety", "lines", "top_word"]
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS, MARKS, STOPS, BEYOND = b"#$%&*@^~|<>{}[]\\_=+/", b"!?", b".,;:", bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: logarithms of counts, square roots
    of shares, smoothed so that a few words say little. All zero for a text without
    words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(text), len(words)
    counts = Counter(words)
    lines = text.split(b"\n")
    share = lambda kind: sqrt((size - len(text.translate(None, kind))) / (size + 40))
    return [
        log1p(n), log1p((sum(map(len, words)) + 40) / (n + 8)), share(UPPER), share(DIGITS), share(SYMBOLS), share(MARKS), share(STOPS), share(BEYOND),
        log1p(len(counts)) / log1p(n), (len(set(lines)) + 2) / (len(lines) + 2), log((len(lines) + 2) / (n + 8)), sqrt(max(counts.values()) / (n + 8)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in blobs(batch.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, x array<double>")


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor and log determinant."""

    prior: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    logdet: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1: the log-density difference z as z / (1 + |z|), which
        keeps its order where a logistic curve would already be flat."""
        if len(self.mean) < 2:
            return np.full(len(x), self.prior[0])
        density = [
            p - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
            for p, m, f, d in zip(self.prior, self.mean, self.factor, self.logdet, strict=True)
        ]
        z = (density[1] - density[0]) / x.shape[1]
        return 0.5 + 0.5 * z / (1 + np.abs(z))


def fit(examples: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """Fit on rows ``(x, label)`` with label 0 or 1; others are left out.

    One aggregation gives counts, sums and second moments of each class, so every
    labelled row counts and the driver gets two rows. A class covariance is shrunk by
    ``shrink`` towards the pooled one and by ``ridge`` towards its mean variance.
    With rows of one class only, every score is the share of label 1 (1 or 0); with
    no rows it is 0.5."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    rows = {r["label"]: r for r in examples.where("label in (0, 1)").groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(x[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("m")).collect()}
    if len(rows) < 2:
        return Discriminant([float(next(iter(rows), 0.5))], [], [], [])
    means, covs, ns = [], [], []
    for label in (0, 1):
        r = rows[label]
        mean = np.array(r["s"]) / r["n"]
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["m"], strict=True):
            second[i, j] = second[j, i] = v / r["n"]
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
        ns.append(r["n"])
    pooled = sum(n * c for n, c in zip(ns, covs, strict=True)) / sum(ns)
    out = Discriminant([], means, [], [])
    for n, cov in zip(ns, covs, strict=True):
        shrunk = (1 - shrink) * cov + shrink * pooled
        shrunk = (1 - ridge) * shrunk + ridge * max(np.trace(shrunk) / d, 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        out.prior.append(log(n / sum(ns)))
        out.factor.append(np.linalg.inv(lower))
        out.logdet.append(2 * float(np.log(np.diag(lower)).sum()))
    return out


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``(id, score)`` of rows ``(id, x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).values).reshape(-1, len(FEATURES)) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])

    return stats.select("id", "x").mapInArrow(run, "id long, score double")


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """Fit on the rows of ``stats`` that ``labels`` (doc_id, label) marks. A document
    that is labelled, or given, more than once counts each time."""
    marks = labels.select(labels.doc_id.cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1)")
    return fit(stats.join(marks, "id").select("x", "label"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all columns,
    in one pass over them."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or b"") for t in blobs(batch.column(at))]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Null ids are scored, never held out and never learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = cut_lineage(features(docs))
    model = learn(stats.where(by_crc(stats, "id", 3) != 1), labels)
    found = scored(stats, model)
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(by_crc(found, "id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
