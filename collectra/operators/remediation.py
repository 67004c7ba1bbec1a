"""Apply accepted corrections in their order, with a change log.

Corrections by record id set a cell whatever it holds; corrections by value
rewrite every cell that holds the value at that moment, so a later correction
sees what earlier ones made. Applying them one after the other would scan the
data once per correction. Instead the order is resolved on the corrections,
which are review-sized:

* each correction points to the next value correction that picks up its result,
  and pointer doubling gives the value it finally leads to;
* a cell then needs only the last correction of its record and, without one,
  the first correction of its value: two lookups per corrected column.

The log follows groups of equal cells, not cells, along the same pointers, also by doubling.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import lookup_join
from .profile import quoted, unused

# FIXED VALUES: id columns in which a record is looked for, in turn.
ID_COLUMNS = ["record_id", "id", "identifier", "ID"]
LOGGED_ONLY = {
    "flag_for_authority_lookup": "Flagged for authority lookup — value unchanged",
    "leave_unchanged_mark_uncertain": "Marked as uncertain — value unchanged",
}
MAX_SEQ = (1 << 62)


def _records(df: DataFrame, accepted: DataFrame, id_columns: list[str]) -> DataFrame:
    """``(item_id, at)``: records that corrections name, with the first id column that holds them."""
    wanted = accepted.select("item_id").where("item_id IS NOT NULL").distinct()
    found = [
        lookup_join(df.select(F.col(quoted(c)).cast("string").alias("item_id")), wanted, ["item_id"], "left_semi").distinct().withColumn("at", F.lit(i))
        for i, c in enumerate(id_columns)
    ]
    return cut_lineage(reduce(DataFrame.union, found).groupBy("item_id").agg(F.min("at").alias("at")))


def _with_key(df: DataFrame, records: DataFrame, id_columns: list[str], key: str) -> DataFrame:
    """The table with a column ``key``: the record a row is corrected as, or, where several id
    columns lead to it, all of them in one text."""
    if len(id_columns) == 1:
        return df.withColumn(key, F.col(quoted(id_columns[0])).cast("string"))
    out, own = df, []
    for i, c in enumerate(id_columns):
        value, hit = f"{key}_value{i}", f"{key}_hit{i}"
        known = records.where(F.col("at") == i).select(F.col("item_id").alias(value), F.lit(True).alias(hit))
        out = lookup_join(out.withColumn(value, F.col(quoted(c)).cast("string")), known, [value], "left")
        own.append(F.when(F.col(hit), F.col(value)))
    items = F.array_distinct(F.array_compact(F.array(*own)))
    return out.withColumn(key, F.when(F.size(items) == 1, items[0]).when(F.size(items) > 1, F.to_json(items))).withColumn(f"{key}_items", items)


def _per_key(rules: DataFrame, keyed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rules by record as rules by row key. A record whose rows have several keys has its rule once
    for each; rule numbers are then spread by the factor returned, to stay in order."""
    keys = keyed.select(F.col(key).alias("key"), F.explode(f"{key}_items").alias("item_id")).distinct()
    place = F.row_number().over(Window.partitionBy("rid").orderBy("key")) - 1
    by_id = cut_lineage(rules.where("kind = 'id'").join(keys, "item_id").withColumn("place", place))
    factor = (by_id.agg(F.max("place")).first()[0] or 0) + 1
    rid = F.col("rid") * factor
    by_id = by_id.withColumn("rid", rid + F.col("place")).withColumn("item_id", F.col("key"))
    return by_id.select(*rules.columns).unionByName(rules.where("kind = 'value'").withColumn("rid", rid)), factor


def _rules(df: DataFrame, accepted: DataFrame, records: DataFrame | None) -> DataFrame:
    """Corrections as rules: kind ``id`` or ``value``, from, to. Rules that
    cannot apply (unknown column, nothing to match) are left out."""
    acts = accepted.where(F.col("action_type").isin("apply_suggested_value", "move_value_to_field", "normalize_label"))
    if records is not None:
        acts = acts.join(records.select("item_id", F.lit(True).alias("_found")), "item_id", "left")
    else:
        acts = acts.withColumn("_found", F.lit(None).cast("boolean"))
    action, found = F.col("action_type"), F.coalesce("_found", F.lit(False))
    created = acts.where((action == "move_value_to_field") & ~F.col("target_field").isin(df.columns)).groupBy("target_field").agg(
        F.min("seq").alias("_made")
    )
    kind = (
        F.when((action == "move_value_to_field") & found, "id")
        .when((action == "apply_suggested_value") & found, "id")
        .when((action == "apply_suggested_value") & ~found & F.col("original_value").isNotNull(), "value")
        .when((action == "normalize_label") & F.col("original_value").isNotNull() & F.col("suggested_value").isNotNull(), "value")
    )
    to = F.when(action == "move_value_to_field", F.coalesce(F.nullif("suggested_value", F.lit("")), "original_value")).otherwise(F.col("suggested_value"))
    known = F.col("target_field").isin(df.columns) | (F.col("_made") <= F.col("seq"))
    return acts.join(created, "target_field", "left").withColumn("kind", kind).where(known & F.col("kind").isNotNull()).select(
        F.col("seq").alias("rid"), "kind", F.col("target_field").alias("column"), "item_id", F.col("original_value").alias("from"), to.alias("to"),
        "suggestion_id", "action_type", F.col("item_id").alias("record"),
    )


def _with_next(rules: DataFrame) -> DataFrame:
    """Add ``nxt``: the first later value rule whose ``from`` is this ``to``."""
    have = rules.where("kind = 'value'").select("column", F.col("from").alias("v"), "rid", F.lit(1).alias("is_have"), F.col("rid").alias("have"))
    need = rules.select("column", F.col("to").alias("v"), "rid", F.lit(0).alias("is_have"), F.lit(None).cast("long").alias("have"))
    later = Window.partitionBy("column", "v").orderBy(F.col("rid").desc(), "is_have").rowsBetween(Window.unboundedPreceding, -1)
    found = have.unionByName(need).withColumn("nxt", F.last("have", ignorenulls=True).over(later)).where("is_have = 0")
    return rules.join(found.select("rid", "nxt"), "rid")


def _with_final(rules: DataFrame) -> DataFrame:
    """Add ``final``: the value at the end of the chain (pointer doubling)."""
    state = cut_lineage(rules.select("rid", F.col("to").alias("final"), F.col("nxt").alias("ptr")))
    while not state.where("ptr IS NOT NULL").isEmpty():
        ahead = state.select(F.col("rid").alias("ptr"), F.col("final").alias("_f"), F.col("ptr").alias("_p"))
        state = cut_lineage(
            state.join(ahead, "ptr", "left").select("rid", F.when(F.col("ptr").isNotNull(), F.col("_f")).otherwise(F.col("final")).alias("final"), F.col("_p").alias("ptr"))
        )
    return rules.join(state.select("rid", "final"), "rid")


def _long(df: DataFrame, id_column: str | None, columns: list[str]) -> DataFrame:
    item = F.col(quoted(id_column)).cast("string") if id_column else F.lit(None).cast("string")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(quoted(c)).cast("string") if c in df.columns else F.lit("")).alias("v")) for c in columns
    ])
    return df.select(item.alias("item_id"), F.explode(cells).alias("c")).select("item_id", "c.*")


def _jumps(values: DataFrame) -> list[DataFrame]:
    """Tables ``(rid, ptr)`` of the rule 1, 2, 4, ... steps ahead; as many as the
    longest chain has binary digits."""
    table = cut_lineage(values.where("nxt IS NOT NULL").select("rid", F.col("nxt").alias("ptr")))
    out = []
    while not table.isEmpty():
        out.append(table)
        ahead = table.select(F.col("rid").alias("ptr"), F.col("ptr").alias("_p"))
        table = cut_lineage(table.join(ahead, "ptr").select("rid", F.col("_p").alias("ptr")))
    return out


def _ends(starts: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Add ``end``: the last rule of the chain from ``rid`` that comes before ``until``."""
    out = starts.withColumn("end", F.col("rid"))
    for table in reversed(jumps):
        ahead = table.select(F.col("rid").alias("end"), "ptr")
        out = out.join(ahead, "end", "left").withColumn("end", F.when(F.col("ptr") < F.col("until"), F.col("ptr")).otherwise(F.col("end"))).drop("ptr")
    return out


def _along(paths: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``(rid, n_cells)``: what paths add to each rule they pass. A path counts from its
    first rule and is taken off behind its last; sums over all that leads to a rule
    then double their reach with every table."""
    off = paths.where("nxt IS NOT NULL").select(F.col("nxt").alias("rid"), (-F.col("cnt")).alias("n"))
    sums = cut_lineage(paths.select("rid", F.col("cnt").alias("n")).unionByName(off).groupBy("rid").agg(F.sum("n").alias("n")))
    for table in jumps:
        moved = sums.join(table, "rid").select(F.col("ptr").alias("rid"), "n")
        sums = cut_lineage(sums.unionByName(moved).groupBy("rid").agg(F.sum("n").alias("n")))
    return sums.withColumnRenamed("n", "n_cells")


def _log(df: DataFrame, rules: DataFrame, first: DataFrame, id_column: str | None, columns: list[str], factor: int) -> DataFrame:
    """Cells each rule changed and, for rules by id, the value before. A rule that stands for
    several row keys has one entry, with its first key's value."""
    cells = _long(df, id_column, columns)
    starts = lookup_join(cells.where("v IS NOT NULL"), first.select("column", F.col("from").alias("v"), F.col("rid")), ["column", "v"], "inner")
    start_counts = starts.groupBy("rid").agg(F.count("*").alias("cnt"))
    id_rules = rules.where("kind = 'id'")
    w = Window.partitionBy("item_id", "column").orderBy("rid")
    spans = id_rules.withColumn("until", F.coalesce(F.lead("rid").over(w), F.lit(MAX_SEQ))).withColumn(
        "prev_rid", F.lag("rid").over(w)).withColumn("prev_to", F.lag("to").over(w)).withColumn("prev_nxt", F.lag("nxt").over(w))
    keys = spans.groupBy("item_id", "column").agg(F.min("rid").alias("s1"))
    held = cut_lineage(lookup_join(cells, keys, ["item_id", "column"], "inner").groupBy("item_id", "column", "v", "s1").agg(F.count("*").alias("cnt")))
    firsts = first.select("column", F.col("from").alias("v"), F.col("rid").alias("rid"))
    held_first = held.join(firsts, ["column", "v"], "left")
    taken = held_first.where("rid IS NOT NULL").groupBy("rid").agg((-F.sum("cnt")).alias("cnt"))
    none = F.lit(None).cast("long")
    frontier = (
        start_counts.unionByName(taken).groupBy("rid").agg(F.sum("cnt").alias("cnt")).select(none.alias("owner"), "rid", F.lit(MAX_SEQ).alias("until"), "cnt")
        .unionByName(held_first.where("rid IS NOT NULL").select(none.alias("owner"), "rid", F.col("s1").alias("until"), "cnt"))
    )
    sizes = held.groupBy("item_id", "column").agg(F.sum("cnt").alias("cnt"), F.min("v").alias("v0"))
    span_sizes = cut_lineage(spans.join(sizes, ["item_id", "column"]))
    frontier = frontier.unionByName(span_sizes.select(none.alias("owner"), F.col("nxt").alias("rid"), "until", "cnt"))
    before = span_sizes.join(firsts.withColumnRenamed("v", "v0").withColumnRenamed("rid", "_first"), ["column", "v0"], "left")
    before = before.withColumn("_v", F.when(F.col("prev_rid").isNull(), F.col("v0")).otherwise(F.col("prev_to"))).withColumn(
        "_r", F.when(F.col("prev_rid").isNull(), F.col("_first")).otherwise(F.col("prev_nxt")))
    frontier = frontier.unionByName(before.select(F.col("rid").alias("owner"), F.col("_r").alias("rid"), F.col("rid").alias("until"), F.lit(0).cast("long").alias("cnt")))
    values = cut_lineage(rules.where("kind = 'value'").select("rid", F.col("to").alias("to"), "nxt"))
    jumps = _jumps(values)
    ends = cut_lineage(_ends(frontier.where("rid IS NOT NULL AND rid < until"), jumps).join(values.withColumnRenamed("rid", "end"), "end"))
    counts = _along(ends.where("owner IS NULL"), jumps)
    reached = ends.where("owner IS NOT NULL").select(F.col("owner").alias("rid"), F.col("to").alias("_to"), F.lit(True).alias("_moved"))
    by_id = before.join(reached, "rid", "left").select(
        "rid", F.col("cnt").alias("n_cells"), F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("_v")).alias("original")
    )
    by_value = rules.where("kind = 'value'").join(counts.where("n_cells > 0"), "rid").select("rid", "n_cells", F.col("from").alias("original"))
    batch = F.col("action_type") == "normalize_label"
    counted = by_id.unionByName(by_value)
    if factor > 1:
        counted = counted.groupBy((F.col("rid") - F.pmod("rid", F.lit(factor))).alias("rid")).agg(
            F.sum("n_cells").alias("n_cells"), F.min_by("original", "rid").alias("original"))
    return rules.join(counted, "rid").withColumn("rid", (F.col("rid") / factor).cast("long") if factor > 1 else F.col("rid")).select(
        "suggestion_id", F.col("rid").alias("seq"), F.when(batch, "batch").otherwise(F.coalesce("record", F.lit(""))).alias("record_id"), "column",
        F.col("original").alias("original_value"), F.col("to").alias("new_value"), "action_type", "n_cells",
        F.when(batch, F.format_string("Batch normalization: %d cells updated", "n_cells")).otherwise("").alias("note"),
    )


def apply_suggestions(
    df: DataFrame, suggestions: DataFrame, id_column: str | None = None, dry_run: bool = False, log: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """(corrected table, change log) of all accepted suggestions in ``seq`` order;
    without ``log`` only the table is worked out.

    A record is looked for in ``id_column``, or in the usual id columns in turn: the first that
    holds it decides. The table may have any further columns.

    A dry run returns the table as it is and the suggestions it would apply.
    New target columns start empty. Splits are advice only and change nothing.
    """
    accepted = suggestions.where("status = 'accepted'").withColumn("seq", F.col("seq").cast("long"))
    if dry_run:
        return df, accepted
    id_columns = [id_column] if id_column else [c for c in ID_COLUMNS if c in df.columns]
    key = unused("row_key", df)
    records, keyed, factor = None, df, 1
    if id_columns:
        records = _records(df, accepted, id_columns)
        keyed = _with_key(df, records, id_columns, key)
    rules = _rules(df, accepted, records)
    if len(id_columns) > 1:
        keyed = cut_lineage(keyed)
        rules, factor = _per_key(rules, keyed, key)
    rules = cut_lineage(_with_next(rules))
    rules = cut_lineage(_with_final(rules))
    columns = sorted(r[0] for r in rules.select("column").distinct().collect())  # schema-sized
    made = [r[0] for r in accepted.where("action_type = 'move_value_to_field'").select("target_field").distinct().collect() if r[0] and r[0] not in df.columns]
    logged_only = accepted.where(F.col("action_type").isin(list(LOGGED_ONLY))).select(
        "suggestion_id", "seq", F.coalesce("item_id", F.lit("")).alias("record_id"), F.coalesce("target_field", F.lit("")).alias("column"),
        "original_value", F.col("original_value").alias("new_value"), "action_type", F.lit(0).cast("long").alias("n_cells"),
        F.when(F.col("action_type") == "flag_for_authority_lookup", LOGGED_ONLY["flag_for_authority_lookup"])
        .otherwise(LOGGED_ONLY["leave_unchanged_mark_uncertain"]).alias("note"),
    )
    out = keyed.withColumns({c: F.lit("") for c in made})
    if not columns:
        return out.select(*map(quoted, [*df.columns, *made])), logged_only if log else None
    first = cut_lineage(rules.where("kind = 'value'").groupBy("column", "from").agg(F.min("rid").alias("rid"), F.min_by("final", "rid").alias("final")))
    changes = _log(keyed, rules, first, key if id_columns else None, columns, factor).unionByName(logged_only) if log else None
    sets, hit = f"{key}_set", f"{key}_to"
    if id_columns:
        last = rules.where("kind = 'id'").groupBy("item_id", "column").agg(F.max_by("final", "rid").alias("final"))
        per_key = last.groupBy(F.col("item_id").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("final")))).alias(sets))
        out = lookup_join(out, per_key, [key], "left")
    else:
        out = out.withColumn(sets, F.lit(None).cast("map<string,struct<final:string>>"))
    valued = {r[0] for r in first.select("column").distinct().collect()}
    for c in columns:
        by_id = F.try_element_at(F.col(sets), F.lit(c))
        by_value = F.col(quoted(c))
        if c in valued:
            table = first.where(F.col("column") == c).select(F.col("from").alias(c), F.struct("final").alias(hit))
            out = lookup_join(out, table, [c], "left")
            by_value = F.when(F.col(hit).isNotNull(), F.col(f"{hit}.final")).otherwise(by_value)
        out = out.withColumn(c, F.when(by_id.isNotNull(), by_id["final"]).otherwise(by_value)).drop(hit)
    return out.select(*map(quoted, [*df.columns, *made])), changes


def mark_applied(suggestions: DataFrame) -> DataFrame:
    return suggestions.withColumn("status", F.when(F.col("status") == "accepted", "applied").otherwise(F.col("status")))


def log_page(log: DataFrame, dataset: Column | None = None, column: str = "") -> DataFrame:
    return log.where(F.col("column") == column) if column else log
