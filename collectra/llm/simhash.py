"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .common import blobs, table, texts
from .components import components

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: bytes, width: int) -> int:
    """64 majority bits over the XXH64 of all shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    ends = ends[width - 1:] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        cuts = map(slice, starts[i:min(n, i + CHUNK)].tolist(), ends[i:i + CHUNK].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fingerprint)`` of every row: A-Z lower-cased, words split at ASCII
    white space. A text of fewer than ``width`` words is one shingle, an empty or
    null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, width) for t in blobs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, fingerprint long")


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def masks(distance: int, bits: list[int], parts: int, fixed: list[int] = ()) -> list[int]:
    """Pigeonhole masks: of ``parts`` blocks, any two values within ``distance``
    agree on all but ``distance`` blocks, so they share a masked value."""
    blocks = [b.tolist() for b in np.array_split(np.array(bits), parts)]
    return [_mask([*fixed, *(x for b in chosen for x in b)]) for chosen in combinations(blocks, parts - distance)]


def _stars(distance: int):
    """Of each bucket, edges that join its linked fingerprints into stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for values in batch.column(0):
                left = np.array(values.values, dtype=np.int64)
                while len(left) > 1:
                    root, group, rest = left[0], left[:1], left[1:]
                    while len(group) and len(rest):
                        near = (np.bitwise_count(group[:, None] ^ rest[None, :]) <= distance).any(axis=0)
                        group, rest = rest[near], rest[~near]
                        u += [root] * len(group)
                        v += group.tolist()
                    left = rest
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def links(prints: DataFrame, distance: int = 2, bucket: int = 2048) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that join all that lie within
    ``distance`` bits, directly or through others.

    Four blocks of 16 bits: pairs at ``distance`` 2 share two whole blocks, so each
    fingerprint goes to six buckets of 32 common bits. A bucket of more than
    ``bucket`` fingerprints is split by the same rule on its other 32 bits (fifteen
    ways, 53 common bits), which leaves at most 2,048 distinct values in one; no
    bucket is cut. Inside a bucket only stars are given back, never all pairs."""
    blocks = distance + 2
    first = masks(distance, list(range(64)), blocks)
    finer = []
    for m in first:
        held = [b for b in range(64) if m >> b & 1]
        finer.append(masks(distance, [b for b in range(64) if b not in held], 2 * blocks - 2, held))
    literal = lambda values: F.array(*[F.lit(m).cast("long") for m in values])
    fp = F.col("fingerprint")
    keys = prints.select("fingerprint", F.posexplode(F.transform(literal(first), lambda m: fp.bitwiseAND(m))).alias("mask", "part"))
    crowded = cut_lineage(keys.groupBy("mask", "part").count().where(F.col("count") > bucket).select("mask", "part"))
    kept = keys.join(crowded, ["mask", "part"], "left_anti").withColumn("level", F.lit(0))
    deeper = F.array(*[literal(ms) for ms in finer])[F.col("mask")]
    split = keys.join(crowded, ["mask", "part"], "left_semi").select(
        "fingerprint", F.col("mask").alias("level"), F.posexplode(F.transform(deeper, lambda m: fp.bitwiseAND(m))).alias("mask", "part"))
    split = split.select("mask", "part", "fingerprint", (F.col("level") + 1).alias("level"))
    buckets = kept.unionByName(split).groupBy("level", "mask", "part").agg(F.collect_list("fingerprint").alias("found"))
    return buckets.where(F.size("found") > 1).select("found").mapInArrow(_stars(distance), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """``(id, fingerprint, component)`` for every row: ``component`` is the smallest id
    that links of at most ``distance`` bits reach. Rows without id get the component
    of their fingerprint (null if it has no id at all) and never name one. Copies
    share a fingerprint and are joined as one value, so the size of a group of
    copies does not matter to the search."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("id").alias("first")))
    roots = components(links(distinct.select("fingerprint"), distance))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = cut_lineage(rooted.join(least, "root").select("fingerprint", "component"))
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: those with its smallest
    id, once if they are repeated. Of a group without any id one row per text fingerprint
    stays."""
    found = cut_lineage(near_duplicates(docs, id_col, text_col, width, distance))
    kept = cut_lineage(found.where("id <=> component").groupBy("id", "fingerprint").count())
    at, name = docs.columns.index(text_col), "simhash_of_text"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, pa.array([fingerprint(t or b"", width) for t in blobs(batch.column(at))], pa.int64()))

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
    out = marked.join(kept, marked[id_col].eqNullSafe(kept.id) & (marked[name] == kept.fingerprint), "left_semi")
    if kept.where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, name])
    return out.select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
