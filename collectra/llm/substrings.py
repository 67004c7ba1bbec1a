"""Substring dedup: repeated word windows found through difference-cover anchors."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blobs, table, texts

#: For any two residues modulo PERIOD, some shift below PERIOD puts both in COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
LAST = np.iinfo(np.int64).max
FLUSH = 1_500_000
_rng = np.random.default_rng(20)
TERMS = _rng.integers(1, 1 << 63, size=(3, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, family: int) -> np.ndarray:
    """A multilinear hash of ``width`` word hashes from each start, its bits mixed."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        out += TERMS[family, k] * words[starts + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def cover_positions(n: int) -> np.ndarray:
    """The positions below ``n`` that the cover holds."""
    at = (np.arange(0, max(n, 0), PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def packed(values: np.ndarray) -> bytes:
    """Mostly rising numbers, as differences, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=0).astype(np.int32).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32), dtype=np.int64)


class Pool:
    """Occurrences of hashes in the documents a task has read, up to a fixed number."""

    def __init__(self):
        self.ids, self.keys, self.parts, self.size = [], [], [], 0

    def add(self, doc: int, key: int, positions: np.ndarray, *hashes: np.ndarray) -> None:
        if len(positions):
            self.parts.append((np.full(len(positions), len(self.ids)), positions, *hashes))
            self.ids.append(doc)
            self.keys.append(key)
            self.size += len(positions)

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*self.parts, strict=True)]


SENT = "bucket int, dest int, positions binary, hashes binary, more binary, owners binary, ids binary, keys binary"
SENT_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
SENT_NAMES = [c.split()[0] for c in SENT.split(", ")]
FOUND = "dest int, positions binary, owners binary, keys binary"
FOUND_KEYS = "key long, positions binary"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(SENT_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SENT_TYPES, strict=True)], SENT_NAMES)


def _known(keys: np.ndarray, positions: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Decided positions, packed: one row per group of documents that are gathered together."""
    if len(keys):
        dest = (keys.view(np.uint64) % np.uint64(groups)).astype(np.int32)
        order = np.lexsort((positions, keys, dest))
        keys, positions, dest = keys[order], positions[order], dest[order]
        for part in np.split(np.arange(len(dest)), np.flatnonzero(np.diff(dest)) + 1):
            used, local = np.unique(keys[part], return_inverse=True)
            yield int(dest[part[0]]), packed(positions[part]), packed(local), used.tobytes()


def _sent(pool: Pool, buckets: int, groups: int, choose: Callable) -> list[tuple]:
    """What a task gives on: for each bucket of hashes one row with its occurrences, one
    per distinct hash, and the positions that are decided here already. ``choose`` gives
    the occurrences to send and those decided."""
    owners, positions, hashes, *more = pool.columns()
    ids, keys = np.array(pool.ids, np.int64), np.array(pool.keys, np.int64)
    send, decided = choose(hashes, more[0] if more else None, ids[owners], positions)
    rows = [(dest, dest, at, None, None, local, None, used) for dest, at, local, used in _known(keys[owners[decided]], positions[decided], groups)]
    bucket = (hashes[send] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((positions[send], owners[send], bucket))
    send, bucket = send[order], bucket[order]
    for part in np.split(send, np.flatnonzero(np.diff(bucket)) + 1) if len(send) else []:
        used, local = np.unique(owners[part], return_inverse=True)
        rows.append((
            int(hashes[part[0]] % np.uint64(buckets)), None, packed(positions[part]), hashes[part].tobytes(), more[0][part].tobytes() if more else None,
            packed(local), ids[used].tobytes(), keys[used].tobytes()))
    return rows


def _received(group: pa.Table) -> tuple[list, tuple[np.ndarray, ...] | None]:
    """The decided rows of a bucket, and its occurrences: keys, ids, positions, hashes and
    further hash bits."""
    out, parts = [], []
    for r in group.to_pylist():
        if r["hashes"] is None:
            out.append(tuple(r[n] for n in FOUND_NAMES))
            continue
        local = unpacked(r["owners"])
        hashes = np.frombuffer(r["hashes"], np.uint64)
        more = np.frombuffer(r["more"], np.uint32) if r["more"] else np.zeros(len(hashes), np.uint32)
        parts.append((np.frombuffer(r["keys"], np.int64)[local], np.frombuffer(r["ids"], np.int64)[local], unpacked(r["positions"]), hashes, more))
    return out, tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else None


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(c, pa.binary() if i else pa.int32()) for i, (n, c) in enumerate(zip(FOUND_NAMES, columns, strict=True))})


def _gather(group: pa.Table) -> pa.Table:
    """All positions of each document of a group: one row ``(key, positions)`` per document."""
    keys, positions = [], []
    for r in group.to_pylist():
        keys.append(np.frombuffer(r["keys"], np.int64)[unpacked(r["owners"])])
        positions.append(unpacked(r["positions"]))
    keys, positions = np.concatenate(keys), np.concatenate(positions)
    order = np.lexsort((positions, keys))
    keys, positions = keys[order], positions[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return pa.table({"key": pa.array(keys[begins]), "positions": pa.array([packed(p) for p in np.split(positions, begins[1:])], pa.binary())})


def _runs(hashes: np.ndarray, more: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where each run of equal hashes begins in that order."""
    order = np.lexsort((*reversed(ties), more, hashes))
    h, m = hashes[order], more[order]
    return order, np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])]))


def _choose_anchors(hashes, more, ids, positions):
    """Anchors that repeat within the task are decided; one of each goes on, as a sign
    for other tasks, and so do all that do not repeat."""
    order, begins = _runs(hashes, np.zeros(len(hashes), np.uint32))
    lengths = np.diff(np.append(begins, len(order)))
    return order[begins], order[np.repeat(lengths > 1, lengths)]


def _repeated_anchors(groups: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        out, found = _received(group)
        if found:
            keys, _, positions, hashes, more = found
            order, begins = _runs(hashes, more)
            lengths = np.diff(np.append(begins, len(order)))
            hit = order[np.repeat(lengths > 1, lengths)]
            out += _known(keys[hit], positions[hit], groups)
        return _table(out)

    return run


def _choose_windows(hashes, more, ids, positions):
    """Only the earliest occurrence in the task goes on; the others are decided."""
    order, begins = _runs(hashes, more, ids, positions)
    first = np.zeros(len(order), bool)
    first[begins] = True
    at = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
    same = (ids[order] == ids[at]) & (positions[order] == positions[at])  # repeated rows do not start earlier
    return order[first], order[~first & ~same]


def _later_windows(groups: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        out, found = _received(group)
        if found:
            keys, ids, positions, hashes, more = found
            order, begins = _runs(hashes, more, ids, positions)
            at = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
            later = order[(ids[order] != ids[at]) | (positions[order] != positions[at])]
            out += _known(keys[later], positions[later], groups)
        return _table(out)

    return run


def _buckets(docs: DataFrame) -> tuple[int, int]:
    """Buckets of hashes, for some megabytes of text each, and groups of documents to which
    positions go back; fewer groups, since each bucket writes to each."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(max(size >> 22, 2 * tasks), 1 << 24)
    return buckets, max(tasks, buckets >> 3)


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """``(key, positions)``: starts of windows that also start earlier, for rows ``(key, id, text)``."""
    anchor = width - PERIOD + 1
    buckets, groups = _buckets(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool()
        for batch in batches:
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
                words = text.split()
                if len(words) >= width:
                    at = cover_positions(len(words) - anchor + 1)
                    pool.add(LAST if doc is None else doc, key, at, window_hashes(word_hashes(words), at, anchor, 0))
                if pool.size >= FLUSH:
                    yield _batch(_sent(pool, buckets, groups, _choose_anchors))
                    pool = Pool()
        if pool.size:
            yield _batch(_sent(pool, buckets, groups, _choose_anchors))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool()
        for batch in batches:
            for key, doc, text, found in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = word_hashes(text.split())
                n = len(words) - width + 1
                open_ = np.zeros(n + 1, np.int64)
                at = unpacked(found)  # an anchor lies in the windows that begin up to PERIOD - 1 before it
                np.add.at(open_, np.minimum(np.maximum(at - PERIOD + 1, 0), n), 1)
                np.add.at(open_, np.minimum(at + 1, n), -1)
                at = np.flatnonzero(np.cumsum(open_[:n]) > 0)
                more = (window_hashes(words, at, width, 2) >> np.uint64(32)).astype(np.uint32)
                pool.add(LAST if doc is None else doc, key, at, window_hashes(words, at, width, 1), more)
                if pool.size >= FLUSH:
                    yield _batch(_sent(pool, buckets, groups, _choose_windows))
                    pool = Pool()
        if pool.size:
            yield _batch(_sent(pool, buckets, groups, _choose_windows))

    def gathered(sent: DataFrame, decide: Callable) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(decide(groups), FOUND).groupBy("dest").applyInArrow(_gather, FOUND_KEYS)

    repeated = cut_lineage(gathered(docs.select("key", "id", "text").mapInArrow(anchors, SENT), _repeated_anchors))
    candidates = docs.join(repeated, "key").select("key", "id", "text", "positions")
    return gathered(candidates.mapInArrow(windows, SENT), _later_windows)


def keep_mask(n: int, width: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no window at ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) == 0


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, text)`` for every row: words that a window of ``width`` words
    covers whose words also start earlier (smaller id, or same id and earlier) are
    removed, and the others joined by single spaces.

    Anchors of ``width - 12`` words are hashed at cover positions only (4 of 13); two
    equal windows share an aligned anchor. A task sends each hash once, in rows packed
    by bucket, and marks repeats it sees itself, so that a passage in a third of
    all documents is one entry per task. Repeated anchors are extended to the windows
    around them; of equal windows (96 hash bits) all but the earliest are marked.
    The text is shuffled once, by a key of id and text, for both uses.

    Null and empty texts have no words. A null id comes after all others. Rows with the
    same id are one document: equal positions do not make each other repeats."""
    if width < PERIOD + 3:
        raise ValueError(f"width must be at least {PERIOD + 3}")
    keyed = texts(docs, id_col, text_col).select(F.xxhash64("id", "text").alias("key"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, found in zip(blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if found:
                    mask = keep_mask(len(words), width, unpacked(found))
                    words = [w for w, k in zip(words, mask.tolist(), strict=True) if k]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "text"])

    both = keyed.join(repeated_windows(keyed, width), "key", "left").select("id", "text", "positions")
    return both.mapInArrow(run, "id long, n_words long, n_removed long, text string")


_WINDOW = ", ".join(["w", *(f"lead(w, {i}) OVER line" for i in range(1, 20))])
#: The same rows in DuckDB: windows as hashed texts, the first of each kept apart.
OP2_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
windows AS (SELECT r, doc_id, i, md5(concat_ws(' ', {_WINDOW})) AS h, lead(w, 19) OVER line IS NOT NULL AS whole FROM words WINDOW line AS (PARTITION BY r ORDER BY i)),
firsts AS (SELECT h, min(struct_pack(d := doc_id, i := i)) AS f FROM windows WHERE whole GROUP BY h),
later AS (SELECT r, i FROM windows JOIN firsts USING (h) WHERE whole AND struct_pack(d := doc_id, i := i) > f),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS i FROM later),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def op2(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
