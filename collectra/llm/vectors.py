"""Embedding near-duplicates: exact cosine threshold pairs by cover-tree dual traversal."""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table
from .components import components

RADII = (1.0, 0.5, 0.25, 0.125)
SLACK = 1e-4  # single precision, used only to rule pairs out
ROWS = len(RADII) + 1  # the level below the leaves: every row is a node
# Pairs compared at a time, numbers gathered for them, numbers in the vectors of a block.
PAIRS, NUMBERS, BLOCK_NUMBERS = 1 << 21, 1 << 22, 1 << 19


def _cover(x: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of rows of ``x`` within ``radius`` of the group's first row; first rows lie
    further apart than that. Rows are taken in order, some hundreds at a time."""
    limit = 1 - radius * radius / 2
    centres, groups = np.empty((0, x.shape[1]), x.dtype), []
    for at in range(0, len(x), 512):
        block = x[at:at + 512]
        owner = np.full(len(block), -1)
        if len(centres):
            near = block @ centres.T
            best = near.argmax(axis=1)
            inside = near[np.arange(len(block)), best] >= limit
            owner[inside] = best[inside]
        left = np.flatnonzero(owner < 0)
        own = block[left] @ block[left].T >= limit
        free, fresh = np.ones(len(left), bool), []
        for i in range(len(left)):
            if free[i]:
                taken = own[i] & free
                taken[i] = True
                owner[left[taken]] = len(groups) + len(fresh)
                fresh.append(left[i])
                free &= ~taken
        centres = np.concatenate([centres, block[fresh]])
        groups += [[] for _ in fresh]
        order = np.argsort(owner, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            groups[owner[part[0]]].append(part + at)
    return [np.concatenate(g) for g in groups]


class Tree:
    """Nested covers of the rows of ``x`` with halving radii. Rows are reordered so that a
    node is a range; ``levels`` holds (first rows, radii, first children) from the whole block down to
    the rows, the first children with the end of the last node's."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray):
        x = _unit(raw.astype(np.float64)).astype(np.float32)
        nodes, tops = [np.arange(len(x))], []
        for radius in RADII:
            parts = [[n] if len(n) == 1 else [n[g] for g in _cover(x[n], radius)] for n in nodes]
            tops.append(np.cumsum([0] + [len(p) for p in parts]))
            nodes = [n for p in parts for n in p]
        order = np.concatenate(nodes)
        self.ids, self.weights, self.raw, self.x = ids[order], weights[order], raw[order], x[order]
        tops.append(np.cumsum([0] + [len(n) for n in nodes]))
        self.levels, begins = [(np.arange(len(x)), np.zeros(len(x)), None)], np.arange(len(x))
        for children in tops[::-1]:
            begins = begins[children[:-1]]
            centre = np.repeat(begins, np.diff(np.append(begins, len(x))))
            radii = np.maximum.reduceat(np.linalg.norm(self.x - self.x[centre], axis=1), begins)
            self.levels.insert(0, (begins, radii, children))

    def packed(self) -> bytes:
        """Numbers only; vectors in the precision they came in."""
        small = [(b.astype(np.int32), r.astype(np.float32) + np.float32(1e-6), c.astype(np.int32)) for b, r, c in self.levels[:-1]]
        return pickle.dumps((self.ids, self.weights, self.raw, small))

    @classmethod
    def unpacked(cls, blob: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.weights, tree.raw, small = pickle.loads(blob)
        tree.x = _unit(tree.raw.astype(np.float64)).astype(np.float32)
        rows = np.arange(len(tree.x))
        tree.levels = [tuple(column.astype(kind) for column, kind in zip(level, (np.int64, np.float64, np.int64), strict=True)) for level in small]
        tree.levels.append((rows, np.zeros(len(rows)), None))
        return tree

    def below(self, level: int, target: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the nodes of ``target``, the next level or that of the rows, below ``nodes``, and their numbers."""
        begins, _, children = self.levels[level]
        ends = children if target == level + 1 else np.append(begins, len(self.x))
        return ends[nodes], ends[nodes + 1] - ends[nodes]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compared(a: Tree, b: Tree, target: int, firsts: tuple, counts: tuple, floor) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs of runs of nodes of one level, the pairs of nodes whose centres' cosine reaches ``floor(their radii)``,
    with that cosine. Long runs are one matrix product after another, short ones are listed; both some at a time."""
    (begins_a, radii_a, _), (begins_b, radii_b, _) = a.levels[target], b.levels[target]
    both = counts[0] * counts[1]
    for p in np.flatnonzero(both >= 4096).tolist():
        (fa, fb), (na, nb) = (int(f[p]) for f in firsts), (int(c[p]) for c in counts)
        for right in range(fb, fb + nb, PAIRS // 64):
            end = min(right + PAIRS // 64, fb + nb)
            columns, widest = np.ascontiguousarray(b.x[begins_b[right:end]].T), radii_b[right:end].max()
            step = max(1, PAIRS // (end - right))
            for left in range(fa, fa + na, step):
                rows = slice(left, min(left + step, fa + na))
                near = a.x[begins_a[rows]] @ columns  # first with the widest node, then with each one's own radius
                least = floor(radii_a[rows] + widest).astype(np.float32)
                i, j = np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])
                cosine = near[i, j]
                i, j = i + left, j + right
                kept = cosine >= floor(radii_a[i] + radii_b[j])
                yield i[kept], j[kept], cosine[kept]
    short = np.flatnonzero(both < 4096)
    ends = np.cumsum(both[short])
    step = max(1, min(PAIRS, NUMBERS // a.x.shape[1]))
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        number = np.arange(at, min(at + step, int(ends[-1])))
        p = short[np.searchsorted(ends, number, side="right")]
        inner = number - (ends - both[short])[np.searchsorted(ends, number, side="right")]
        i, j = firsts[0][p] + inner // counts[1][p], firsts[1][p] + inner % counts[1][p]
        cosine = np.einsum("ij,ij->i", a.x[begins_a[i]], b.x[begins_b[j]])
        kept = cosine >= floor(radii_a[i] + radii_b[j])
        yield i[kept], j[kept], cosine[kept]


def near_rows(a: Tree, b: Tree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of both trees whose cosine reaches the threshold, or of one tree with itself, each pair once, some at a time.

    The trees are walked together: a pair of nodes is dropped where the distance of the centres exceeds reach and both
    radii. Where the children of both nodes are hardly fewer than their rows, the rows are compared at once. A pair is
    followed to its rows before the next ones are taken, so what is held does not grow with the pairs. Rows
    that single precision leaves open are compared in double precision."""
    reach, width = sqrt(2 - 2 * threshold), a.x.shape[1]
    slack = max(SLACK, 1.2e-7 * (width + 4))

    def apart(radii: np.ndarray) -> np.ndarray:
        return 1 - (reach + radii) ** 2 / 2 - slack

    def linked(radii: np.ndarray) -> np.ndarray:
        return np.full(len(radii), threshold - slack)

    def exact(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        sure, step = cosine >= threshold + slack, max(1, NUMBERS // width)
        open_ = np.flatnonzero(~sure)
        for at in range(0, len(open_), step):
            part = open_[at:at + step]
            va, vb = a.raw[i[part]].astype(np.float64), b.raw[j[part]].astype(np.float64)
            sure[part] = np.einsum("ij,ij->i", va, vb) / np.linalg.norm(va, axis=1) / np.linalg.norm(vb, axis=1) >= threshold
        return sure

    def walk(level: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        few = np.zeros(len(left), bool)
        for tree, nodes in ((a, left), (b, right)):
            few |= 2 * tree.below(level, level + 1, nodes)[1] < tree.below(level, ROWS, nodes)[1]
        for target, taken in ((ROWS, ~few), (level + 1, few)):
            if not taken.any():
                continue
            (fa, na), (fb, nb) = a.below(level, target, left[taken]), b.below(level, target, right[taken])
            for i, j, cosine in _compared(a, b, target, (fa, fb), (na, nb), linked if target == ROWS else apart):
                if a is b:
                    once = i < j if target == ROWS else i <= j
                    i, j, cosine = i[once], j[once], cosine[once]
                if target == ROWS:
                    sure = exact(i, j, cosine)
                    i, j = i[sure], j[sure]
                if len(i):
                    yield from [(i, j)] if target == ROWS else walk(target, i, j)

    yield from walk(0, np.zeros(1, np.int64), np.zeros(1, np.int64))


class Forest:
    """Rows joined by links, which are taken in some at a time and not kept."""

    def __init__(self):
        self.root, self.waiting, self.held = np.arange(0), [], 0

    def grow(self, more: int) -> int:
        """The first of so many new rows."""
        size = len(self.root)
        self.root = np.concatenate([self.root, np.arange(size, size + more)])
        return size

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.root[i], self.root[j]
        fresh = i != j
        if fresh.any():
            self.waiting.append((i[fresh], j[fresh]))
            self.held += len(self.waiting[-1][0])
        if self.held >= PAIRS // 4 or len(self.waiting) >= 4096:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest row that each row is joined with."""
        root = self.root
        i, j = (np.concatenate(c) for c in zip(*self.waiting, strict=True)) if self.waiting else (root[:0], root[:0])
        self.waiting, self.held = [], 0
        while len(i):
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while len(np.flatnonzero(root[root] != root)):
                root[:] = root[root]
            i, j = root[i], root[j]
            i, j = i[i != j], j[i != j]
        return root


def links(low: list[bytes], high: list[bytes] | None, meet, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the packed trees of one group of blocks link with those of another, or with each other: the ids of rows with links and
    the weighted numbers of these, and a forest of edges with the same components as the links. ``meet`` says of the places of two trees
    whether to compare them. The memory is that of the trees and some numbers for each row, however many links there are."""
    forest, trees, counts, starts = Forest(), [], [], []

    def entered(blob: bytes) -> Tree:
        tree = Tree.unpacked(blob)
        trees.append(tree.ids)
        counts.append(np.zeros(len(tree.ids), np.int64))
        starts.append(forest.grow(len(tree.ids)))
        return tree

    mine = [entered(blob) for blob in low]
    for k, other in enumerate(mine if high is None else map(entered, high)):
        at = k if high is None else len(mine) + k
        for m, tree in enumerate(mine[:k + 1] if high is None else mine):
            if not meet(m, k):
                continue
            for i, j in near_rows(tree, other, threshold):
                counts[m] += np.bincount(i, other.weights[j], len(tree.ids)).astype(np.int64)
                counts[at] += np.bincount(j, tree.weights[i], len(other.ids)).astype(np.int64)
                forest.add(i + starts[m], j + starts[at])
    ids, counts, root = np.concatenate(trees), np.concatenate(counts), forest.settle()
    some, joined = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
    return ids[some], counts[some], ids[joined], ids[root[joined]]


def near_pairs(distinct: DataFrame, width: int, threshold: float, block: int = 8192, most_cells: int = 4096, most_group: int = 16) -> DataFrame:
    """``(u, v, links)`` for distinct vectors ``(uid, n, v)`` of one width: rows with ``v`` null
    give ``u`` its links to other vectors, counted with their copies; the others are edges
    that join what links join.

    The top of the cover tree is drawn on the cluster: vectors go to the nearest of up to
    ``most_cells`` centres, cells are cut into blocks of about ``block`` vectors, fewer if they are wide, and
    two blocks meet only if their centres lie within the reach and both radii. Each block's
    tree is built once. Blocks in a row form a group; a pair of groups is one task's work, and a tree goes once to each
    pair that it meets a block of, so that what is sent grows with the blocks up to ``12 * most_group`` of them, then with their square by ``most_group``."""
    spark = distinct.sparkSession
    size = distinct.count()
    block = max(1, min(block, BLOCK_NUMBERS // width))
    cells = max(1, min(most_cells, ceil(size / block)))
    chosen = distinct.orderBy(F.xxhash64("uid"), "uid").limit(cells).select("v").toArrow().column("v").combine_chunks()
    if not len(chosen):
        return spark.createDataFrame([], "u long, v long, links long")
    centres = _unit(np.asarray(chosen.flatten(), np.float64).reshape(-1, width)).astype(np.float32)
    step = max(1, min(PAIRS // cells, NUMBERS // width))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                x = np.asarray(batch.column(2).flatten(), np.float32).reshape(-1, width)
                unit = _unit(x.astype(np.float64)).astype(np.float32)
                cell = (unit @ centres.T).argmax(axis=1)
                far = np.linalg.norm(unit - centres[cell], axis=1)
                raw = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], ["uid", "n", "v", "cell", "far"])

    placed = cut_lineage(distinct.select("uid", "n", "v").mapInArrow(nearest, "uid long, n long, v binary, cell int, far double"))
    known = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("cell").collect()
    cuts, fars = np.zeros(cells, np.int64), np.zeros(cells)
    for r in known:
        cuts[r["cell"]], fars[r["cell"]] = ceil(r["n"] / (2 * block)), r["far"]
    firsts = np.cumsum(cuts) - cuts
    group = max(1, min(most_group, int(cuts.sum()) // 12))
    groups = ceil(int(cuts.sum()) / group)
    reach = sqrt(2 - 2 * threshold)

    def partners(cell: int) -> np.ndarray:
        """The cells that may hold a vector within reach of one of this cell."""
        apart = np.linalg.norm(centres - centres[cell], axis=1)
        return (cuts > 0) & (apart <= reach + fars[cell] + fars + 1e-3)

    def build(rows: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float32).reshape(-1, width)
        tree = Tree(np.asarray(rows.column("uid")), np.asarray(rows.column("n")), raw)
        number = rows.column("number")[0].as_py()
        cell = int(np.searchsorted(firsts + cuts, number, side="right"))
        met = np.flatnonzero(partners(cell))
        sent = np.zeros(groups + 1, np.int64)
        np.add.at(sent, firsts[met] // group, 1)
        np.add.at(sent, (firsts[met] + cuts[met] - 1) // group + 1, -1)
        return pa.table({"number": pa.array([number], pa.int32()), "theirs": pa.array([np.flatnonzero(np.cumsum(sent)).tolist()], pa.list_(pa.int32())),
                         "tree": pa.array([tree.packed()], pa.binary())})

    numbers = spark.createDataFrame([(c, int(firsts[c]), int(cuts[c])) for c in np.flatnonzero(cuts).tolist()], "cell int, first int, cuts int")
    number = (F.col("first") + F.pmod(F.xxhash64("uid"), "cuts")).cast("int")
    blocks = placed.join(F.broadcast(numbers), "cell").select(number.alias("number"), "uid", "n", "v").groupBy("number").applyInArrow(
        build, "number int, theirs array<int>, tree binary")
    own = F.floor(F.col("number") / group).cast("int")
    sent = blocks.select("number", own.alias("own"), F.explode("theirs").alias("their"), "tree")
    sent = sent.select(F.least("own", "their").alias("low"), F.greatest("own", "their").alias("high"), "number", "tree")

    def run(rows: pa.Table) -> pa.Table:
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        sides: list[list] = [[], []]
        for at, n in enumerate(rows.column("number").to_pylist()):
            sides[n // group != low].append((n, rows.column("tree")[at].as_buffer()))
        cells_of = [[int(np.searchsorted(firsts + cuts, n, side="right")) for n, _ in side] for side in sides]
        met = [partners(c) for c in cells_of[0]]
        there = cells_of[low != high]
        u, counts, v, w = links([t for _, t in sides[0]], None if low == high else [t for _, t in sides[1]], lambda m, k: met[m][there[k]], threshold)
        nothing, empty = [pa.nulls(len(c), pa.int64()) for c in (u, v)], pa.int64()
        return pa.table({"u": pa.concat_arrays([pa.array(u, empty), pa.array(v, empty)]), "v": pa.concat_arrays([nothing[0], pa.array(w, empty)]),
                         "links": pa.concat_arrays([pa.array(counts, empty), nothing[1]])})

    tasks = min(groups * (groups + 1) // 2, 4096)
    return sent.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(run, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192) -> DataFrame:
    """``(id, n_links, component)`` for every row: how many other rows have a cosine of at
    least ``threshold`` (double precision), and the smallest id that links reach.

    Equal vectors are joined first and count with their number. A null, empty or zero
    vector, or one with null or non-finite parts, links with nothing, and its
    component is its own id; vectors of other lengths never link. Rows without id
    count as others but never name a component."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("v"))
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select("id", F.when(sound, v).alias("v"))
    distinct = cut_lineage(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn(
        "uid", F.monotonically_increasing_id()))
    found = None
    for r in distinct.select(F.size("v").alias("width")).distinct().collect():
        part = cut_lineage(near_pairs(distinct.where(F.size("v") == r["width"]), r["width"], threshold, block))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "uid")
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "uid")
    named = distinct.join(counts, "uid", "left").join(roots, "uid", "left").select("v", "first", "n", "links", F.coalesce("root", "uid").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = cut_lineage(named.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"))
    linked = rows.where("v is not null").join(named, "v").select("id", "n_links", "component")
    return linked.unionByName(rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


#: The same rows in DuckDB, from all pairs.
OP9_SQL = """WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.vec_id),
roots AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN roots USING (vec_id) LEFT JOIN n USING (vec_id)"""


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
