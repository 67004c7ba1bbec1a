"""Connected components of an undirected graph by alternating star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """From edges ``(u, v)`` of longs to ``(node, root)``: every node that is not
    the smallest of its component, with that smallest node. Loops, repeated and
    reversed edges are allowed; no edges give no rows.

    A large-star step links the larger neighbours of a node with the smallest one,
    a small-star step the smaller ones; the edge set ends as one star per
    component after a number of rounds that grows with the logarithm of the longest
    chain. Each round is two aggregations with map-side combining and two joins
    on plain keys, and is written to the shared folder."""
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
