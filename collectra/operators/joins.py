"""Joins and groupings that stay even when one key holds a large share of rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A frame is broadcast only when both measures hold.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Keys above this share of all rows are hot; there can be at most 1/HOT_SHARE of them.
HOT_SHARE = 1.0 / 512


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure the frame, rows and bytes, with a sum per task. Hand in a frame that is
    written or cheap; :func:`lookup_join` writes its lookup side first."""
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(1)) + F.lit(8) for c in df.columns],
    )
    row = df.select(width.cast("long").alias("w")).agg(F.count("*").alias("n"), F.sum("w").alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def lookup_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join a large frame with a lookup table on equal keys.

    The lookup is written once, so that measuring it and joining it do not work it
    out twice. One that measures small is broadcast and the large side is not
    shuffled. Otherwise the keys are counted once. Where one is hot, or null in many
    rows, rows with hot keys are split off (so that a chain of lookups does not repeat the large side
    without need): their part of the lookup (at most 1/HOT_SHARE keys) is broadcast when it measures small and
    salted when it does not, and only the remaining, even keys are shuffled.
    """
    keys = [on] if isinstance(on, str) else list(on)
    small = cut_lineage(small)
    if fits_broadcast(small):
        return big.join(F.broadcast(small), keys, how)
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_null", any_null(keys))
    row = counts.agg(F.sum("_n").alias("rows"), F.max(F.when(~F.col("_null"), F.col("_n"))).alias("most"), F.sum(F.when(F.col("_null"), F.col("_n"))).alias("nulls")).first()
    total = (row["rows"] or 0) - (row["nulls"] or 0)
    if max(row["most"] or 0, row["nulls"] or 0) <= max(1.0, total * HOT_SHARE):
        return big.join(small.hint("merge"), keys, how)
    keyed = big.where(~any_null(keys))
    # at most 1/HOT_SHARE keys, written so that the plan does not hold their search several times
    hot = F.broadcast(cut_lineage(counts.where(~F.col("_null") & (F.col("_n") > max(1.0, total * HOT_SHARE))).select(*keys)))
    hot_big, cold_big = keyed.join(hot, keys, "left_semi"), keyed.join(hot, keys, "left_anti")
    hot_small, cold_small = small.join(hot, keys, "left_semi"), small.join(hot, keys, "left_anti")
    cold = cold_big.join(cold_small.hint("merge"), keys, how)  # small on disk may be large in the driver
    if fits_broadcast(hot_small):
        warm = hot_big.join(F.broadcast(hot_small), keys, how)
    else:
        warm = salted_join(hot_big, hot_small, keys, how)
    out = warm.unionByName(cold)
    if how == "left":
        out = out.unionByName(big.where(any_null(keys)), allowMissingColumns=True)
    elif how == "left_anti":
        out = out.unionByName(big.where(any_null(keys)))
    return out


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, salts: int = 64) -> DataFrame:
    """Spread each key over ``salts`` tasks; the right side is repeated per salt.
    The salt depends on the row only, so a recomputed task makes the same split."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    salted = left.withColumn("_salt", F.pmod(row_hash, F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def ordered_text(
    rows: DataFrame, keys: list[str], value: str, order: str, out: str, sep: str = "; "
) -> DataFrame:
    """Distinct values of each group in first-seen order, joined to one text.

    Copies collapse in the map-side combine, so a group moves one row per
    distinct value and task; what meets in one task is the text of one output
    cell, which no row of a result table can do without.
    """
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("_ord"))
    pairs = F.array_sort(F.collect_list(F.struct("_ord", value)))
    text = F.concat_ws(sep, F.transform(pairs, lambda p: p[value]))
    return firsts.groupBy(*keys).agg(text.alias(out))


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``. Catalyst turns the rank filter
    into a per-partition limit, so each task ships one row per key at most."""
    return top_rows(rows, keys, order, 1).drop("_rank")


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "_rank") -> DataFrame:
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
