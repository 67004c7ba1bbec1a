"""Byte-level BPE: texts to ids over overlapping chunks, and ids to bytes."""
from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blobs, table, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 16
#: A chunk reads on into the next one by this share of its length.
OVERLAP = 8
#: What a match has to leave unread before the end of its chunk to be sure: the longest fixed alternative and one more.
MARGIN = 4

ENCODED = "id long, ids binary"


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(path: str, pattern: str):
    """A function from text to packed little-endian 32-bit ids, without special tokens."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _rows(ids, found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "ids"])


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """``(row, id, chunk, last, text)``: chunk k holds the characters from ``k * size`` on, and the
    overlap behind them. Written in small row groups, so that one long text is read by many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                text = raw.decode("utf-8", "replace")
                for k, at in enumerate(range(0, max(1, len(text) - size // OVERLAP), size)):
                    last = at + size + size // OVERLAP >= len(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([key], pa.int64()), pa.array([k], pa.int32()), pa.array([last]), pa.array([text[at:at + size + size // OVERLAP]])],
                        ["row", "id", "chunk", "last", "text"])
                row += 1

    return cut_lineage(docs.mapInArrow(run, "row long, id long, chunk int, last boolean, text string"), row_group=8 << 20)


def starts(text: str, pattern) -> np.ndarray:
    """Where the pre-tokens of a text begin, and its end."""
    return np.cumsum([0, *map(len, pattern.findall(text))])


def kind(c: str) -> str:
    """What decides where a pre-token ends: letter, number, white space, other; empty for
    characters that one version of Unicode knows and another may not."""
    category = unicodedata.category(c)
    return "" if category == "Cn" else "s" if c.isspace() else category[0] if category[0] in "LN" else "o"


def meeting_places(at: np.ndarray, text: str) -> np.ndarray:
    """Starts at which a visible character meets one of another kind. A text cut there splits
    before it as it did in one piece: only white space and ' look at what follows."""
    found = []
    for i in at.tolist():
        if 0 < i < len(text) and text[i - 1] != "'":
            before, here = kind(text[i - 1]), kind(text[i])
            if before and here and before != "s" and before != here:
                found.append(i)
    return np.array(found, np.int64)


def scanned(parts: DataFrame, size: int, pattern: str) -> DataFrame:
    """``(row, chunk, last, heads, tails)``: the pre-token borders that a chunk finds in its own
    overlap with the chunk before it, and in that with the chunk after it, both counted
    from where the overlap begins. Borders near the chunk's end are left out of the latter."""
    overlap = size // OVERLAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                at = starts(text, split)
                places = meeting_places(at, text)
                heads.append(places[places < overlap].tolist())
                sure = at[at <= len(text) - MARGIN]
                tails.append((places[(places > size) & (places <= (sure[-1] if len(sure) else 0))] - size).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "chunk", "last")), *(pa.array(c, pa.list_(pa.int32())) for c in (heads, tails))],
                ["row", "chunk", "last", "heads", "tails"])

    return parts.mapInArrow(run, "row long, chunk int, last boolean, heads array<int>, tails array<int>")


def stitched(borders: DataFrame) -> DataFrame:
    """``(row, chunk, begin, end, whole)``: each chunk's own piece, from where it met the chunk before
    it to where it meets the next one. ``whole`` is false for all chunks of a text in which two
    neighbours never meet."""
    line = Window.partitionBy("row").orderBy("chunk")
    meets = F.array_min(F.array_intersect("tails", F.lead("heads").over(line)))
    met = borders.withColumn("meet", meets).select("row", "chunk", "last", "meet")
    return met.select(
        "row", "chunk", F.coalesce(F.lag("meet").over(line), F.lit(0)).alias("begin"), F.col("meet").alias("end"),
        F.min(F.col("last") | F.col("meet").isNotNull()).over(Window.partitionBy("row")).alias("whole"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for every row: the ids of a text by the ranks in ``path``, packed as little-endian
    unsigned 32-bit numbers; ``pattern`` splits the text before the merges.

    A text of more than ``size`` characters is cut into overlapping chunks, which many tasks
    pre-tokenise. Two neighbours are stitched where both find a border in their overlap: from
    there on the rest of the text decides, so both go on alike. Each piece is encoded on its
    own and the ids are put in order. Where two neighbours share no border (a run of letters
    longer than the overlap), the text is done again in chunks of eight times the size.

    Null and empty texts have no ids. Rows are handled one by one, repeated ones and
    those without id too. Bytes that are not UTF-8 are read as U+FFFD."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = texts(docs, id_col, text_col)
    longer = F.length("text") > size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, pattern)
        for batch in batches:
            yield _rows(batch.column(0), [ids_of(t.decode("utf-8", "replace")) for t in blobs(batch.column(1))])

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, pattern)
        for batch in batches:
            cuts = zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end")), strict=True)
            found = [ids_of(text[begin:len(text) if end is None else size + end]) for text, begin, end in cuts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "chunk")), pa.array(found, pa.binary())], ["row", "id", "chunk", "ids"])

    def ordered(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("chunk")
        return pa.table({"id": pieces["id"][:1], "ids": pa.array([b"".join(pieces["ids"].to_pylist())], pa.binary())})

    out = rows.where(~longer).mapInArrow(run, ENCODED)
    todo = chunks(rows.where(longer), size)
    while not todo.isEmpty():
        cuts = cut_lineage(stitched(scanned(todo, size, pattern)))
        whole = todo.join(cuts.where("whole").drop("whole"), ["row", "chunk"])
        out = out.union(whole.mapInArrow(piece, "row long, id long, chunk int, ids binary").groupBy("row").applyInArrow(ordered, ENCODED))
        failed = todo.join(cuts.where(~F.col("whole")).select("row", "chunk"), ["row", "chunk"])
        failed, size = _rejoined(failed, size), 8 * size
        todo = chunks(failed, size)
    return out


def _rejoined(parts: DataFrame, size: int) -> DataFrame:
    """``(id, text)`` of chunked texts."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        parts = group["text"].to_pylist()
        text = "".join(t[:size] for t in parts[:-1]) + parts[-1]
        return pa.table({"id": group["id"][:1], "text": pa.array([text], pa.string())})

    return parts.select("row", "id", "chunk", "text").groupBy("row").applyInArrow(run, "id long, text string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(id, ids, bytes)``: the bytes of each row's ids, one after the other. No ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            found = [b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["id", "ids", "bytes"])

    return encoded.select("id", "ids").mapInArrow(run, ENCODED + ", bytes binary")


def op13(spark, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
