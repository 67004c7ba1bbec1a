"""Authority data: wide columns to matches, matching by name, candidates."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ENTITY_TO_AUTHORITY, authority_uri, mapped
from ..functions.text import collapse_blanks, has_text, parse_confidence, split_values, strip
from .joins import best_row, lookup_join, top_rows
from .profile import quoted


@dataclass
class WideSchema:
    """Column name patterns of an authority-merged table; ``{n}`` is the slot."""

    term: str = "named_entity_{n}"
    id: str = "named_entity_{n}_gnd_id"
    preferred: str = "named_entity_{n}_gnd_preferredName"
    confidence: str = "named_entity_{n}_gnd_konfidenz"
    type: str = "named_entity_{n}_gnd_type"
    alternatives: str = "named_entity_{n}_gnd_alternativen"
    record_id: str = "record_id"

    def slots(self, df: DataFrame) -> int:
        """Number of consecutive slots whose id column exists."""
        n = 0
        while self.id.format(n=n + 1) in df.columns:
            n += 1
        return n


def wide_matches(df: DataFrame, schema: WideSchema | None = None, slots: int | None = None) -> DataFrame:
    """One row per filled slot; a narrow projection without any shuffle."""
    schema = schema or WideSchema()
    n = min(slots or schema.slots(df), schema.slots(df))

    def cell(pattern: str, i: int) -> Column:
        name = pattern.format(n=i)
        return F.coalesce(strip(F.col(quoted(name)).cast("string")), F.lit("")) if name in df.columns else F.lit("")

    def slot(i: int) -> Column:
        return F.struct(
            F.lit(i).alias("slot"), cell(schema.term, i).alias("term"), cell(schema.id, i).alias("authority_id"),
            F.coalesce(F.nullif(cell(schema.preferred, i), F.lit("")), cell(schema.term, i)).alias("preferred_name"),
            cell(schema.type, i).alias("authority_type"), parse_confidence(cell(schema.confidence, i)).alias("confidence"),
            split_values(cell(schema.alternatives, i)).alias("alternatives"),
        )

    filled = F.filter(F.array(*[slot(i) for i in range(1, n + 1)]), lambda s: s["authority_id"] != "")
    order = [F.col("ord")] if "ord" in df.columns else []
    return df.select(F.col(quoted(schema.record_id)).cast("string").alias("record_id"), *order, F.explode(filled).alias("s")).select(
        "record_id", *order, "s.*", F.lit("csv").alias("source")
    )


def low_confidence(matches: DataFrame, threshold: float = 0.75) -> DataFrame:
    return matches.where(F.col("confidence") < threshold).select("record_id", "term", "authority_id", "confidence", "slot")


def match_key(c: Column) -> Column:
    return F.lower(collapse_blanks(c))


def authority_names(authority: DataFrame) -> DataFrame:
    """Every name of an authority record: preferred first, then variants
    (an array column)."""
    own = F.array(F.struct(F.lit(0).alias("rank"), F.col("preferred_name").alias("name")))
    other = F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda v: F.struct(F.lit(1).alias("rank"), v.alias("name")))
    named = authority.withColumn("_n", F.explode(F.concat(own, other))).withColumn("name", match_key(F.col("_n.name")))
    return named.where(has_text(F.col("name"))).groupBy("name", "authority_id").agg(
        F.min("_n.rank").alias("name_rank"), F.first("preferred_name").alias("preferred_name"),
        F.first("authority_type").alias("authority_type"), F.first("source").alias("source"), F.min("ord").alias("ord"),
    )


def rank_score(rank: Column, step: float = 0.2, floor: float = 0.2) -> Column:
    return F.greatest(F.lit(floor), F.round(F.lit(1.0) - (rank - 1) * F.lit(step), 4))


def position_score(rank: Column) -> Column:
    return rank_score(rank, 0.15, 0.3)


def match_terms(terms: DataFrame, authority: DataFrame, k: int = 5, by_type: bool = True) -> DataFrame:
    """Up to ``k`` authority records per distinct (text, entity_type), best name
    first. Each record counts once per term. The type filter is part of the
    join key, so a name shared by many types does not fan out."""
    wanted = terms.select("text", "entity_type").distinct().withColumn("name", match_key(F.col("text")))
    records = authority_names(authority)
    keys = ["name"]
    if by_type:
        wanted = wanted.withColumn("_type", mapped(F.col("entity_type"), ENTITY_TO_AUTHORITY, "*"))
        kinds = F.array_distinct(F.array(F.lit("*"), F.coalesce("authority_type", F.lit("*"))))
        records = records.withColumn("_type", F.explode(kinds))
        keys = ["name", "_type"]
    # no text can use more than k records of a key: rank them before the join
    best = top_rows(records, keys, [F.col("name_rank"), F.col("ord")], k).drop("_rank")
    joined = lookup_join(wanted, best, keys, "inner")
    return top_rows(joined, ["text", "entity_type"], [F.col("name_rank"), F.col("ord")], k, "rank").select(
        "text", "entity_type", "authority_id", "preferred_name", "authority_type", "source", "rank",
        rank_score(F.col("rank")).alias("score"),
    )


def top_matches(matches: DataFrame) -> DataFrame:
    return matches.where("rank = 1")


def match_counts(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: terms looked up, terms with a match, candidates."""
    total = terms.select("text", "entity_type").distinct().agg(F.count("*").alias("total"))
    found = matches.agg(F.count_if(F.col("rank") == 1).alias("matched"), F.count("*").alias("candidates"))
    return total.unionByName(found, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("total", "matched", "candidates")])


def candidates(matches: DataFrame, entries: DataFrame, spellings: DataFrame, position: bool = False) -> DataFrame:
    """Matches as review candidates of the dictionary entry their text leads to."""
    from .dictionary import lookup

    keyed = lookup(matches, "text", entries, spellings).withColumnRenamed("key", "entry_id")
    score = position_score(F.col("rank")) if position else F.col("score")
    return keyed.select(
        "entry_id", "text", "source", "authority_id", "preferred_name", "authority_type",
        authority_uri(F.col("source"), F.col("authority_id")).alias("uri"), score.alias("score"), F.lit("pending").alias("status"),
        F.sha2(F.concat_ws("|", "text", "source", "authority_id"), 256).alias("candidate_id"),
    )


def dedupe_results(results: DataFrame, key: list[str], limit: int) -> DataFrame:
    """First result per authority id, then at most ``limit`` per key."""
    firsts = best_row(results, [*key, "authority_id"], [F.col("ord")])
    return top_rows(firsts, key, [F.col("ord")], limit, "rank")


def commit_candidates(entries: DataFrame, accepted: DataFrame) -> DataFrame:
    """Write accepted candidates into dictionary entries.

    Per source the last accepted candidate wins. A GND id that comes with a
    Wikidata record only fills a gap, first one first; so does the preferred
    name. ``entries`` has entry_id and the authority columns.
    """
    def of(source: str) -> Column:
        return F.col("source") == source

    record = F.struct("authority_id", "preferred_name", "authority_type", "uri")
    lasts = {s: F.max_by(record, F.when(of(s), F.col("ord"))).alias(s) for s in ("gnd", "wikidata", "geonames")}
    side = of("wikidata") & (F.coalesce(F.col("linked_gnd_id"), F.lit("")) != "")
    chosen = accepted.where(F.col("status") == "accepted").groupBy("entry_id").agg(
        *lasts.values(), F.min_by("linked_gnd_id", F.when(side, F.col("ord"))).alias("_linked"),
        F.min_by("preferred_name", F.when(has_text(F.col("preferred_name")), F.col("ord"))).alias("_name"), F.count("*").alias("committed"),
    )
    joined = entries.join(chosen, "entry_id", "left")  # both sides have one row per entry
    parts = {"id": "authority_id", "preferred": "preferred_name", "type": "authority_type", "uri": "uri"}
    changed = {}
    for s in lasts:
        for short, field in parts.items():
            old = F.col(f"{s}_{short}") if f"{s}_{short}" in entries.columns else F.lit("")
            changed[f"{s}_{short}"] = F.when(F.col(s).isNotNull(), F.col(f"{s}.{field}")).otherwise(F.coalesce(old, F.lit("")))
    changed["gnd_id"] = F.coalesce(F.nullif(changed["gnd_id"], F.lit("")), "_linked", F.lit(""))
    old_name = F.col("preferred_name") if "preferred_name" in entries.columns else F.lit(None).cast("string")
    changed["preferred_name"] = F.coalesce(F.nullif(old_name, F.lit("")), "_name", F.lit(""))
    changed["committed"] = F.coalesce("committed", F.lit(0))
    rest = [c for c in entries.columns if c not in changed]
    return joined.select(*rest, *[v.alias(k) for k, v in changed.items()])


def enrichment(entries: DataFrame) -> DataFrame:
    """One row: entries with and without any authority id."""
    some = F.concat(*[F.coalesce(c, F.lit("")) for c in ("gnd_id", "wikidata_id", "geonames_id") if c in entries.columns]) != ""
    return entries.agg(
        F.count("*").alias("total"), F.count_if(some).alias("enriched"), F.count_if(~some).alias("unenriched")
    )
