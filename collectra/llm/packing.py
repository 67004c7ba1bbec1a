"""Best-fit packing of documents into token sequences, certified by lower bounds."""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blobs, table, texts

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids of white-space separated words as packed little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids are
    its words' ids in order. Latin-1 words of letters only, with or without closing
    marks, go straight to the merge model; all others take the whole tokenizer."""

    LIMIT, LONGEST = 1_000_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {i: as_bytes(chr(i))[0][0] for i in range(256) if chr(i).isalpha()}

    def _encode(self, word: str) -> bytes:
        if word.isalpha() and ord(max(word)) < 256:
            found = [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(self.letters))]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?")
        text = core.decode()
        if core != word and text.isalpha() and ord(max(text)) < 256:
            found = self[text.lower().encode()] + self[word[len(core):]]
        else:
            found = self._encode(word.decode())
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = found
        return found


def token_ids(text: bytes, path: str) -> bytes:
    """The packed ids of a text, then the end id. The words met so far stay with the
    worker process, for its next tasks too: they hang on an installed module, as the
    functions of this package travel by value and begin anew with each task."""
    kept = vars(public_tokenizers).setdefault("word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return b"".join(map(kept[path].__getitem__, text.split())) + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, size: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents as ``(id, piece, start, length, ids_crc32)``: one piece, or
    pieces of ``size`` and a last one for longer documents. A null text is empty
    and has the end id alone."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                ids = token_ids(text, path)
                for i, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    rows.append((key, i, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def lower_bound(counts: dict[int, int], size: int) -> int:
    """The least number of bins for ``{length: how many}`` by two families of dual-
    feasible functions: one rounds lengths over ``size - t`` up to a full bin and
    those under ``t`` down to nothing, one rounds multiples of ``size / (k + 1)`` to
    shares of 1 / k."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[v] for v in sorted(counts)], np.int64)
    if not len(lengths):
        return 0
    best = -(-int((lengths * n).sum()) // size)
    for t in np.unique(np.minimum(lengths, size - lengths)):
        if 0 < t <= size // 2:
            value = np.where(lengths > size - t, size, np.where(lengths < t, 0, lengths))
            best = max(best, -(-int((value * n).sum()) // size))
    for k in range(1, 33):
        scaled = lengths * (k + 1)
        share = np.where(scaled % size == 0, lengths * k, (scaled // size) * size)
        best = max(best, -(-int((share * n).sum()) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Open bins are kept by
    free space; a bit mask finds the least free space that still fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: dict[int, list[int]] = defaultdict(list)
    mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            found = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            found, free, used = used, size, used + 1
        bins[i], offsets[i] = found, size - free
        if free > need:
            by_free[free - need].append(found)
            mask |= 1 << (free - need)
    return bins, offsets, used


PACKED = PIECES + ", turn int, part long, bin long, offset long, gap long"


def _packed(rows: DataFrame, parts: int, size: int, turn: int) -> DataFrame:
    """Best-fit decreasing in each of ``parts`` groups; ``gap`` is what a bin leaves free."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        length = group["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(length, size)
        fill = np.bincount(bins, weights=length, minlength=used).astype(np.int64)
        return group.assign(turn=turn, bin=bins, offset=offsets, gap=size - fill[bins])[[c.split()[0] for c in PACKED.split(", ")]]

    # dealt by content, so that a lost task is repeated with the same groups
    part = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", F.lit(turn)), F.lit(parts)).alias("part")
    return rows.select("id", "piece", "start", "length", "ids_crc32", part).groupBy("part").applyInPandas(run, PACKED)


def pack(rows: DataFrame, size: int = 4096, group_bins: int = 20_000, group_rows: int = 1_000_000) -> DataFrame:
    """Packs pieces ``(id, piece, start, length, ids_crc32)``, adding ``sequence_id`` and
    ``offset``.

    Groups of about ``group_bins`` bins, and at most about ``group_rows`` pieces, are
    packed apart by best-fit decreasing. The histogram of lengths (at most ``size``
    numbers) gives a lower bound for all bins together. While the total is above it, the
    bins that have gaps give up their documents, which are dealt anew over an
    eighth of the groups (never more than a group may hold) and packed again; a turn
    that saves no bin is discarded and ends the exchange. Rows that are repeated are
    packed as often as they come; no rows give no sequences."""
    rows = cut_lineage(rows)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bound = lower_bound(counts, size)

    def groups(n: int, tokens: int) -> int:
        return max(1, ceil(tokens / (size * group_bins)), ceil(n / group_rows))

    n, tokens = sum(counts.values()), sum(k * v for k, v in counts.items())
    parts, turn, settled = groups(n, tokens), 0, []
    held = cut_lineage(_packed(rows, parts, size, turn))
    first = F.col("offset") == 0
    total = held.where(first).count()
    while total > bound and parts > 1:
        gaps = held.where("gap > 0")
        n, tokens, before = gaps.agg(F.count("*"), F.sum("length"), F.sum(first.cast("long"))).first()
        fewer = max(ceil(parts / 8), groups(n, tokens or 0))
        turn += 1
        again = cut_lineage(_packed(gaps, fewer, size, turn))
        after = again.where(first).count()
        if after >= before:
            break
        settled.append(held.where("gap = 0"))
        held, total, parts = again, total - before + after, fewer
    out = held
    for done in settled:
        out = out.unionByName(done)
    number = F.shiftleft(F.col("turn").cast("long"), 56) + F.shiftleft("part", 28) + F.col("bin")
    return out.select("id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
