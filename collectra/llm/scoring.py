"""LM scoring: a log-bilinear model trained with noise-contrastive estimation."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blobs, by_crc, table, texts

END = b"\n"  # no word holds white space
CONTEXT, WIDTH, NOISE, BATCH = 5, 24, 32, 2048
WORDS, ENDINGS = 320, 191
KNOWN_WORDS, KNOWN_BYTES = 131_072, 48
PIECE_BYTES, PIECE_TOKENS = 8 << 20, 16 * BATCH
NO_TOKENS = bytes(2 * CONTEXT)  # the context before a text: end tokens, two bytes each
LN10 = log(10)


@dataclass
class Vocabulary:
    """Outputs of the model: frequent words, then endings that stand for all other words.

    ``counts`` holds the training counts of at most ``KNOWN_WORDS`` words of at most
    ``KNOWN_BYTES`` bytes; the rest is looked up by a join. ``mass`` is, per ending,
    the sum of (count + 1) over its words plus one for a word not seen."""

    tokens: int
    distinct: int
    counts: dict[bytes, int]
    words: dict[bytes, int]
    endings: dict[bytes, int]
    prior: np.ndarray
    mass: np.ndarray

    @property
    def size(self) -> int:
        return len(self.prior)

    def ending(self, word: bytes) -> int:
        return self.endings.get(word[-2:], len(self.words))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, text)`` in a row, at most about ``PIECE_BYTES`` of text at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return words.filter(filled).cast(pa.binary()), np.diff(ends[at])


def word_counts(rows: DataFrame, limit: int = 400_000) -> DataFrame:
    """``(word, n)`` over all rows ``(id, text)``, an end token for each. Tasks add up the
    counts of their pieces to tables of about ``limit`` words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in batches:
            ends += batch.num_rows
            for piece in pieces(batch):
                held.append(pa.Table.from_arrays(pc.value_counts(split(piece.column(1))[0]).flatten(), ["word", "n"]))
                size += held[-1].num_rows
                if size > limit:
                    summed = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
                    held = [summed.select(["word", "n_sum"]).rename_columns(["word", "n"])]
                    size = held[0].num_rows
                if size > limit:
                    yield from held[0].to_batches()
                    held, size = [], 0
        for counts in held:
            yield from counts.to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The totals and the bounded part of the counts. The endings, the last two bytes of
    a word, are aggregated over all words: at most 65,792 rows."""
    short = counts.where(F.length("word") <= KNOWN_BYTES).withColumn("step", F.floor(F.log2("n") * 32).cast("int"))
    steps = short.groupBy("step").agg(F.count("*").alias("words")).toPandas().sort_values("step", ascending=False)  # at most 2,048 steps
    fits = steps["step"][steps["words"].cumsum() <= KNOWN_WORDS]
    top = short.where(F.col("step") >= int(fits.min())).select("word", "n").toPandas() if len(fits) else short.limit(0).toPandas()
    known = dict(sorted(zip(map(bytes, top["word"]), top["n"].tolist(), strict=True), key=lambda r: (-r[1], r[0])))
    chosen = [w for w in known if w != END][:WORDS]
    words = {END: 0} | {w: i + 1 for i, w in enumerate(chosen)}
    # words by their last two bytes, at most 65,792 groups
    ends = counts.groupBy(F.expr("substring(word, greatest(length(word) - 1, 1), 2)").alias("end")).agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct")).toPandas()
    total, distinct = int(ends["n"].sum()), int(ends["distinct"].sum())
    n = dict(zip(map(bytes, ends["end"]), ends["n"].tolist(), strict=True))
    d = dict(zip(map(bytes, ends["end"]), ends["distinct"].tolist(), strict=True))
    for w in words:
        if w in known:
            n[w[-2:]] -= known[w]
            d[w[-2:]] -= 1
    best = sorted((e for e in n if n[e] > 0), key=lambda e: (-n[e], e))[:ENDINGS]
    endings = {e: len(words) + 1 + i for i, e in enumerate(best)}
    size = len(words) + 1 + len(endings)
    mass, seen = np.zeros(size), np.zeros(size)
    for w, i in words.items():
        seen[i] = known.get(w, 0)
    for e in n:
        i = endings.get(e, len(words))
        seen[i] += n[e]
        mass[i] += n[e] + d[e]
    mass[len(words):] += 1
    return Vocabulary(total, distinct, known, words, endings, (seen + 1) / (seen + 1).sum(), mass)


class Model:
    """Predicts a vector from the ``CONTEXT`` tokens before, each weighted per place and
    dimension, and scores each output by its product with that vector and a bias."""

    def __init__(self, size: int, prior: np.ndarray):
        rng = np.random.default_rng(7)
        self.inputs = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
        self.outputs = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
        self.places = np.full((CONTEXT, WIDTH), 1.0, np.float32)
        self.bias = np.log(prior).astype(np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.places, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for a in self.arrays():
            a[...] = flat[at:at + a.size].reshape(a.shape)
            at += a.size
        return self

    def placed(self) -> list[np.ndarray]:
        """The input vectors as they count at each place."""
        return [self.inputs * p for p in self.places]

    @staticmethod
    def predicted(context: np.ndarray, placed: list[np.ndarray]) -> np.ndarray:
        out = placed[0].take(context[:, 0], axis=0)
        for c in range(1, CONTEXT):
            out += placed[c].take(context[:, c], axis=0)
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all outputs."""
        out = np.empty(len(target), np.float32)
        weights, placed = np.ascontiguousarray(self.outputs.T), self.placed()
        factors, longest, most = np.exp(self.bias), np.linalg.norm(self.outputs, axis=1).max(), np.abs(self.bias).max()
        scores = np.empty((min(256, max(1, len(target))), len(self.bias)), np.float32)
        for i in range(0, len(target), 256):
            c, t = context[i:i + 256], target[i:i + 256]
            h, s = self.predicted(c, placed), scores[:len(t)]
            np.matmul(h, weights, out=s)
            own = s[np.arange(len(t)), t] + self.bias[t]
            if np.linalg.norm(h, axis=1).max() * longest + most < 80:  # no product can overflow or vanish
                np.exp(s, out=s)
                out[i:i + 256] = own - np.log(s @ factors)
            else:
                s += self.bias
                top = s.max(axis=1, keepdims=True)
                out[i:i + 256] = own - top[:, 0] - np.log(np.exp(s - top).sum(axis=1))
        return out


def windows(ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """For each token of one document, the tokens before it, nearest first; end tokens before
    the start. With ``at`` only for tokens at these places, none of them among the first ``CONTEXT``."""
    if at is None:
        ids = np.concatenate([np.zeros(CONTEXT, ids.dtype), ids])
        at = np.arange(CONTEXT, len(ids))
    out = np.empty((CONTEXT, len(at)), ids.dtype)
    for c in range(CONTEXT):
        out[c] = ids.take(at - (c + 1))
    return out.T


def cut(ids: bytes) -> Iterator[tuple[int, bytes]]:
    """A document's outputs, two bytes each, in pieces of ``PIECE_TOKENS``: the place of the
    piece and its bytes, led by those of the ``CONTEXT`` tokens before it."""
    for i in range(0, len(ids), 2 * PIECE_TOKENS):
        yield i // 2, (ids[i - len(NO_TOKENS):i] if i else NO_TOKENS) + ids[i:i + 2 * PIECE_TOKENS]


def joined(led: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as one array, the numbers of their tokens and each token's place in its piece;
    the tokens that lead a piece have places below zero."""
    lengths = np.array([len(p) // 2 for p in led])
    begins = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(led), "<u2"), lengths - CONTEXT, np.arange(lengths.sum()) - np.repeat(begins + CONTEXT, lengths)


class Trainer:
    """Minibatch steps of noise-contrastive estimation with Adagrad. The noise words of a
    batch are drawn from the unigram distribution and shared, so that both sides are
    matrix products."""

    def __init__(self, model: Model, prior: np.ndarray, seed: int, rate: float):
        self.m, self.rng, self.rate = model, np.random.default_rng(seed), rate
        self.edges = np.cumsum(prior)
        self.log_noise = (np.log(prior) + log(NOISE)).astype(np.float32)
        self.squares = [np.full(a.shape, 0.05, np.float32) for a in model.arrays()]
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory used again in every step: fresh pages for large arrays cost more than their arithmetic."""
        size = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def _descend(self, i: int, gradient: np.ndarray) -> None:
        self.squares[i] += gradient * gradient
        self.m.arrays()[i][...] -= self.rate * gradient / np.sqrt(self.squares[i])

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        before = np.ascontiguousarray(context.T, np.intp)
        vectors = m.inputs.take(before, axis=0, out=self._room("vectors", CONTEXT, n, WIDTH), mode="clip")
        h = np.einsum("cij,cj->ij", vectors, m.places)
        out, away = m.outputs.take(target, axis=0), m.outputs[noise]
        lift = m.bias - self.log_noise
        true = np.einsum("ij,ij->i", h, out) + lift[target]
        false = np.matmul(h, away.T, out=self._room("false", n, NOISE))
        false += lift[noise]
        gt = -1 / (1 + np.exp(np.clip(true, -30, 30))) / n
        gf = np.exp(np.clip(np.negative(false, out=false), -30, 30, out=false), out=false)
        gf += 1
        np.divide(np.float32(1 / n), gf, out=gf)
        dh = np.multiply(gt[:, None], out, out=out)
        dh += gf @ away
        rows, sides = np.concatenate([target, noise]), np.concatenate([gt[:, None] * h, gf.T @ h])
        outputs = self._gathered(rows, np.ascontiguousarray(sides.T))
        bias = self._gathered(rows, np.concatenate([gt, gf.sum(axis=0)])[None])[:, 0]
        places = np.einsum("cij,ij->cj", vectors, dh)
        values = np.multiply(np.ascontiguousarray(dh.T)[:, None], m.places.T[:, :, None], out=vectors.reshape(WIDTH, CONTEXT, n))
        inputs = self._gathered(before.ravel(), values.reshape(WIDTH, -1))  # all places in one
        for i, g in enumerate((inputs, outputs, places, bias)):
            self._descend(i, g * np.float32(n ** 0.5))

    def _gathered(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum of the values of each output's rows, for each dimension."""
        into = np.empty((len(self.m.bias), len(values)), np.float32)
        for i, column in enumerate(values):
            into[:, i] = np.bincount(rows, column, len(into))
        return into


class Codes:
    """Numbers words: those with counts at hand from 0, others, not kept, by their ending
    after those. Per number: the model's output, log10(count + 1), and whether the word
    is one of its ending rather than an output of its own."""

    def __init__(self, vocab: Vocabulary):
        known = vocab.counts if END in vocab.counts else {END: 0} | vocab.counts
        self.known, self.endings = pa.array(list(known), pa.binary()), pa.array(list(vocab.endings), pa.binary())
        self.first, self.end, self.rare = len(known), list(known).index(END), len(vocab.words)
        own = [vocab.words.get(w, -1) for w in known]
        ends = np.arange(vocab.size)
        self.outputs = np.concatenate([[vocab.ending(w) if i < 0 else i for w, i in zip(known, own, strict=True)], ends]).astype(np.int32)
        self.logs = np.concatenate([np.log10(np.array(list(known.values()), float) + 1), np.zeros(vocab.size)])
        self.within = np.concatenate([np.array(own) < 0, np.zeros(vocab.size, bool)])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Of words in a row, as Arrow's binary type."""
        out = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().copy()
        others = np.flatnonzero(out < 0)
        ends = pc.index_in(pc.binary_slice(words.take(pa.array(others)), -2), value_set=self.endings).fill_null(-1).to_numpy()
        out[others] = self.first + self.rare + 1 + ends  # vocab.ending: the rare endings' output comes before the others
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        """Of a text's words and its end token."""
        return np.append(self.numbers(pa.array(words, pa.binary())), self.end)


def number(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row ``(id, text)`` all that training and scoring need of the text, so that it is cut
    into words once for both: the outputs of its tokens (two bytes each), its hash, and the
    sums over words whose counts are at hand. The other words are kept as ``rest``, each once."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(vocab))  # built-in types, which any executor can read
    names = ["row", "id", "n_tokens", "n_known", "logs", "shares", "hash", "outputs", "rest", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(**shared.value)
        codes = Codes(vocab)
        # endings: the model gives their mass, the count the share in it
        share = np.where(vocab.mass > 0, -np.log10(np.maximum(vocab.mass, 1)), 0.0)[codes.outputs] + codes.logs * codes.within
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for piece in pieces(batch):
                words, lengths = split(piece.column(1))
                numbers, ends = codes.numbers(words), np.concatenate([[0], np.cumsum(lengths)])
                others = np.flatnonzero(numbers >= codes.first)
                bounds = np.searchsorted(others, ends)
                left = words.take(pa.array(others)).to_numpy(zero_copy_only=False).tolist()
                rest, times, upto = [], [], [0]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = Counter(left[a:b])
                    rest += own
                    times += own.values()
                    upto.append(len(rest))
                together = np.insert(numbers, ends[1:], codes.end)
                tokens = lengths + 1
                begins = np.cumsum(tokens) - tokens
                borders = np.append(begins, len(together)).astype(np.int32) * 2
                outputs = pa.Array.from_buffers(pa.binary(), len(tokens), [
                    None, pa.py_buffer(borders), pa.py_buffer(codes.outputs[together].astype("<u2"))])
                known = tokens - np.diff(bounds) - (vocab.counts.get(END, 0) == 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(tokens))), piece.column(0), pa.array(tokens), pa.array(known),
                    pa.array(np.add.reduceat(codes.logs[together], begins)), pa.array(np.add.reduceat(share[together], begins)),
                    pa.array([crc32(t) for t in blobs(piece.column(1))], pa.int64()), outputs,
                    pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(rest, pa.binary())),
                    pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(times, pa.int64()))], names)
                row += len(tokens)

    return cut_lineage(rows.mapInArrow(run, (
        "row long, id long, n_tokens long, n_known long, logs double, shares double, hash long, outputs binary, rest array<binary>, times array<long>")))


def train(rows: DataFrame, vocab: Vocabulary) -> Model:
    """Trains on the documents ``(id, text)``, all of them."""
    return fit(number(rows, vocab), vocab)


def fit(numbered: DataFrame, vocab: Vocabulary, turns: tuple[tuple[int, float], ...] = ((16, 0.12), (1, 0.06))) -> Model:
    """Trains on documents that ``number`` has read, all of them, in ``turns`` of (stride, rate).

    In a turn each task starts from the same parameters and takes steps over every
    ``stride``-th token of each of its documents, in context, from an offset that the
    text's hash gives, so that the end token is a target as often as it comes; the last
    turn takes every token. The parameters are then
    averaged by the number of tokens behind them. They are sent as one row per
    parameter block, added up map-side by Spark, and come back as one vector of fixed
    size. Without tokens the start values stay: uniform contexts, unigram biases."""
    prior = vocab.prior
    model = Model(vocab.size, prior)
    for turn, (stride, rate) in enumerate(turns):
        start = model.flat()

        def run(batches: Iterator[pa.RecordBatch], start=start, stride=stride, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            local = Model(len(prior), prior).load(start)
            part = TaskContext.get().partitionId()
            trainer = Trainer(local, prior, 1000 * turn + part, rate)
            led, offsets, held, used = [], [], 0, 0

            def steps():
                nonlocal led, offsets, held, used
                ids, lengths, places = joined(led)
                first = np.repeat(np.array(offsets), lengths + CONTEXT)
                at = np.flatnonzero((places >= 0) & (places % stride == first)) if stride > 1 else np.flatnonzero(places >= 0)
                order = trainer.rng.permutation(at)
                for i in range(0, len(order), BATCH):
                    own = order[i:i + BATCH]
                    trainer.step(windows(ids, own), ids.take(own))
                used += len(at)
                led, offsets, held = [], [], 0

            for batch in batches:
                for text_hash, outputs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for place, piece in cut(outputs.as_py()):
                        led.append(piece)
                        offsets.append((text_hash - place) % stride)
                        held += len(piece) // 2
                        if held >= PIECE_TOKENS * stride:
                            steps()
            if held:
                steps()
            if used:
                values = local.flat().astype(np.float64) * used
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n), pa.int32()), pa.array(values), pa.array(np.full(n, used, np.int64))], ["at", "value", "tokens"])

        sums = numbered.select("hash", "outputs").mapInArrow(run, "at int, value double, tokens long").groupBy("at").agg(
            F.sum("value").alias("value"), F.sum("tokens").alias("tokens")).toPandas().sort_values("at")
        if len(sums):
            model.load((sums["value"] / sums["tokens"]).to_numpy(np.float32))
    return model


def score(numbered: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """Per row that ``number`` has read: ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    The model's part is summed over each row's tokens; the words whose counts were not
    at hand are joined with the counts by word, and added up per row number."""
    prior, flat = vocab.prior, model.flat()
    names = ["row", "id", "n_tokens", "n_known", "logs", "shares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(len(prior), prior).load(flat)
        for batch in batches:
            neural = np.zeros(batch.num_rows)
            led, rows, held = [], [], 0

            def add():
                nonlocal led, rows, held
                ids, lengths, places = joined(led)
                at = np.flatnonzero(places >= 0)
                own = local.log_probabilities(windows(ids, at), ids.take(at))
                np.add.at(neural, rows, np.add.reduceat(own, np.cumsum(lengths) - lengths, dtype=np.float64))
                led, rows, held = [], [], 0

            for i, outputs in enumerate(batch.column(len(names))):
                for _, piece in cut(outputs.as_py()):
                    led.append(piece)
                    rows.append(i)
                    held += len(piece) // 2
                    if held >= PIECE_TOKENS:  # so many at a time
                        add()
            if held:
                add()
            columns = batch.columns[:len(names) - 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(batch.column(len(names) - 1).to_numpy() + neural / LN10)], [*names[:-1], "neural"])

    schema = "row long, id long, n_tokens long, n_known long, logs double, neural double"
    scored = cut_lineage(numbered.select(*names, "outputs").mapInArrow(run, schema))
    rest = numbered.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    found = rest.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known"))
    least = log10(vocab.tokens + vocab.distinct + 1)
    more = F.coalesce("more_logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + more - F.col("n_tokens") * least).alias("base_score"), (F.col("neural") + more).alias("score"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulo: int = 7, held: int = 2) -> DataFrame:
    """Log10 probabilities of every row's text under the log-bilinear model (``score``) and
    under add-one unigram counts (``base_score``), learnt from rows whose ``crc32(id)``
    modulo ``modulo`` is not ``held``. Rows without id are scored, not learnt from. An
    empty or null text is its end token.

    A word outside the model's own list gets the probability of its ending times its
    share (count + 1) in that ending, so that all words and one unseen word per ending
    share one distribution. Without training rows all outputs are alike."""
    rows = texts(docs, id_col, text_col)
    learnt = rows.where(by_crc(rows, "id", modulo) != held)
    counts = cut_lineage(word_counts(learnt))
    vocab = vocabulary(counts)
    numbered = number(rows, vocab)
    model = fit(numbered.where(by_crc(numbered, "id", modulo) != held), vocab)
    found = score(numbered, counts, vocab, model)
    return found.select(
        "id", F.coalesce(by_crc(found, "id", modulo) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
