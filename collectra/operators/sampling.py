"""Reproducible samples and row numbers without a global sort.

Rows are ordered by a hash of seed and id. The leading hash digits cut that
order into even buckets; bucket counts tell which buckets are inside the
sample, and the one bucket on the border is cut again by the next digits until
it is small enough to be ranked.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import lookup_join
from .profile import quoted

#: Rows of one border bucket that a task may rank.
BORDER = 100_000
#: The first part of a row's key is the hash of its id.
ID_DIGITS = 32


def sample_order(id_column: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(quoted(id_column)).cast("string")))


def content_hash(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns])))


def _by_quota(df: DataFrame, id_column: str, strata: list[str], quota: Column, seed: int, digits: int) -> DataFrame:
    """Rows whose hash rank within the stratum is at most ``quota`` (an
    expression over ``_total``, the size of the stratum).

    A row's key is the hash of its id and then that of its content, so only equal
    rows have equal keys. Each turn counts the open rows by stratum and the next
    ``digits`` of the key: buckets below the border are taken whole, those above
    it left, and the one on it stays open. A stratum has one open bucket, a
    16**digits-th of the turn before, and the turns end when none is above ``BORDER``
    rows. Rows that share their id go straight on to the digits of their content, and
    rows that are equal in every column are taken by number."""
    groups = [f"_s{i}" for i in range(len(strata))]
    keyed = [F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row"), *[F.col(quoted(c)).alias(g) for c, g in zip(strata, groups, strict=True)]]
    key = F.concat(sample_order(id_column, seed), content_hash(df)).alias("_key")
    opened_rows = df.select(*keyed, key, F.lit(None).cast("long").alias("_rest"))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    taken, at = [], 1
    while True:
        opened = opened_rows.withColumn("_bucket", F.substring("_key", at, digits))
        counts = opened.groupBy(*groups, "_bucket").agg(
            F.count("*").alias("_n"), F.first("_rest").alias("_rest"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
        # at most 16**digits rows per stratum, so one task can hold a stratum
        buckets = cut_lineage(
            counts.withColumn("_total", F.sum("_n").over(part))
            .withColumn("_upto", F.sum("_n").over(part.orderBy("_bucket")))
            .withColumn("_need", (F.coalesce("_rest", quota.cast("long")) - (F.col("_upto") - F.col("_n"))).cast("long"))
            .where(F.col("_need") > 0)
            .select(*groups, "_bucket", F.col("_need").alias("_rest"), "_n", (F.col("_need") >= F.col("_n")).alias("_whole"),
                    (F.col("_low") == F.col("_high")).alias("_equal"), (F.substring("_low", 1, ID_DIGITS) == F.substring("_high", 1, ID_DIGITS)).alias("_one_id"))
        )
        rows = opened.drop("_rest")
        where = [*groups, "_bucket"]
        taken.append(lookup_join(rows, buckets.where("_whole").select(*where), where, "inner").select("_row"))
        border = buckets.where(~F.col("_whole"))
        equal, most, one_id = border.agg(F.max("_equal"), F.max(F.when(~F.col("_equal"), F.col("_n"))), F.min("_one_id")).first()
        if equal:  # rows that are equal in every column: one of them stands for as many as are needed
            same = lookup_join(rows, border.where("_equal").select(*where, "_rest"), where, "inner")
            one = same.groupBy(*where).agg(F.first("_row").alias("_row"), F.first("_rest").alias("_rest"))
            taken.append(one.select("_row", F.explode(F.expr("sequence(1, _rest)"))).select("_row"))
        if most is None:
            break
        opened_rows = lookup_join(rows, border.where(~F.col("_equal")).select(*where, "_rest"), where, "inner")
        if most <= BORDER:
            rank = F.row_number().over(Window.partitionBy(*where).orderBy("_key"))
            taken.append(opened_rows.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_rest")).select("_row"))
            break
        at = ID_DIGITS + 1 if one_id and at <= ID_DIGITS else at + digits
        opened_rows = cut_lineage(opened_rows.drop("_bucket"))
    return reduce(DataFrame.union, taken).select("_row.*")


def sample_rows(df: DataFrame, id_column: str, n: int, seed: int = 42, digits: int = 3) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer)."""
    return _by_quota(df, id_column, [], F.lit(n), seed, digits)


def sample_percent(df: DataFrame, id_column: str, percent: float, seed: int = 42, digits: int = 3) -> DataFrame:
    """``percent`` of the rows, at least one."""
    return _by_quota(df, id_column, [], F.greatest(F.lit(1), F.bround(F.col("_total") * (percent / 100.0))), seed, digits)


def sample_stratified(df: DataFrame, id_column: str, stratum: str, fraction: float, seed: int = 42, digits: int = 3) -> DataFrame:
    """The same share of every stratum, at least one row each. The stratum
    column is kept, and a stratum of any size is cut by its hash buckets."""
    return _by_quota(df, id_column, [stratum], F.greatest(F.lit(1), F.bround(F.col("_total") * fraction)), seed, digits)


def sampling_plan(df: DataFrame, id_column: str, n: int = 0, percent: float | None = None, stratify_by: str = "", seed: int = 42) -> DataFrame:
    """The sample a run asks for: size or percent, stratified or not. A
    stratified sample that rounding made too large is thinned to its target."""
    if not stratify_by:
        if percent is not None:
            return sample_percent(df, id_column, percent, seed)
        return sample_rows(df, id_column, n, seed) if n else df
    total = df.count()
    target = max(1, round(total * percent / 100.0)) if percent is not None else min(n or total, total)
    if total == 0 or target >= total:
        return df
    return sample_rows(sample_stratified(df, id_column, stratify_by, target / total, seed), id_column, target, seed)


def spot_check(items: DataFrame, strategy: str = "random", n: int = 20, seed: int = 42, key: str = "ord") -> DataFrame:
    """A few pending items to look at: at random, least confident first, or by type."""
    pending = items.where(F.col("status") == "pending")
    order = {
        "low_confidence": [F.col("confidence"), F.col(key)],
        "by_type": [F.col("entity_type"), F.col(key)],
    }.get(strategy, [sample_order(key, seed)])
    return pending.orderBy(*order).limit(n)


def row_numbers(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in the given order, as a column ``name``.

    Rows are dealt to tasks by ranges of the order and sorted there, once, into a written
    table; the sizes of the ranges (one number per task) give where each begins.
    Rows that are equal in ``order`` share a range: end it with what tells them apart."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut_lineage(ranges.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row"), F.monotonically_increasing_id().alias("_at")))
    split = held.select("_row", F.shiftrightunsigned("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before, begins = 0, []
    for part, n in sorted(map(tuple, split.groupBy("_part").count().collect())):
        begins.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(begins, "_part long, _before long")
    return split.join(F.broadcast(offsets), "_part").select("_row.*", (F.col("_before") + F.col("_at") + 1).alias(name))


def chunk_numbers(df: DataFrame, order: str, size: int) -> DataFrame:
    """Number rows by a column and cut them into chunks of ``size``. Rows that are equal in
    it are told apart by a hash of their content, so a value that many rows
    share is numbered by many tasks."""
    numbered = row_numbers(df, F.col(quoted(order)), content_hash(df))
    return numbered.withColumn("chunk", (F.floor((F.col("row_no") - 1) / size) + 1).cast("long"))
