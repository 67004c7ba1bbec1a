"""Rule checks. Each takes a :class:`Dataset` and returns findings.

Counts and example ids come from two narrow passes over the cells: a grouped
count with map-side combine, and a rank filter that ships at most ``n`` ids per
task and group. No check collects the affected rows.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import mapped
from ..functions.text import edge_blank, has_text, is_missing, split_terms
from ..session import cut_lineage
from .profile import SHORT, Dataset, cells, column_profile, long_cells, quoted, value_counts
from .joins import lookup_join, top_rows

FINDING = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("record_ids", T.ArrayType(T.StringType())),
    T.StructField("evidence", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("pattern", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StructType([
        T.StructField("canonical", T.StringType()),
        T.StructField("forms", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]))),
    T.StructField("suggestion", T.StringType()),
])

# FIXED VALUES: traces of UTF-8 text read as Latin-1, and what they were.
MOJIBAKE = {
    "Ã¤": "UTF-8/Latin-1 ae-umlaut",
    "Ã¶": "UTF-8/Latin-1 oe-umlaut",
    "Ã¼": "UTF-8/Latin-1 ue-umlaut",
    "Â": "Stray Latin-1 artifact",
}
# FIXED VALUES: remarks in the reasoning columns of an authority merge.
NO_MATCH_REMARK, LOOKUP_REMARK = "Kein GND-Match", "API-Abfrage empfohlen"

#: Above so many cells of one kind, bounds for the example ids come first, from one in so many ids.
MANY_HITS, PART = 100_000, 128

# Order in which the checks run; findings keep it in ``ord``.
ORD_MISSING, ORD_DUPLICATE, ORD_ENCODING, ORD_FORMAT, ORD_VARIANTS, ORD_AUTHORITY, ORD_LINKAGE = range(7)


def finding(df: DataFrame, source_name: str, order: int, **fields: Column) -> DataFrame:
    """Bring a frame of check results into the findings schema."""
    given = {"dataset": F.lit(source_name), "ord": F.lit(order), **fields}
    given.setdefault("record_ids", F.array().cast("array<string>"))
    given.setdefault("evidence", F.create_map().cast("map<string,double>"))
    return df.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields]
    )


def evidence(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("double"))]
    return F.create_map(*pairs)


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def first_ids(hits: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Ascending first ``n`` record ids per key, as ``record_ids``; at most
    ``n`` ids of a key leave a task."""
    ranked = top_rows(hits.where(F.col("record_id").isNotNull()), keys, [F.col("record_id")], n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"))


def with_ids(counted: DataFrame, hits: DataFrame, keys: list[str], n: int, id_column: str | None) -> DataFrame:
    if not id_column:
        return counted.withColumn("record_ids", F.array().cast("array<string>"))
    # one row per key on the right, and the keys are columns and check kinds
    joined = counted.join(F.broadcast(first_ids(hits, keys, n)), keys, "left")
    return joined.withColumn("record_ids", F.coalesce("record_ids", F.array().cast("array<string>")))


def cell_marks() -> dict[str, Column]:
    """Kind of defect -> condition on a cell."""
    value = F.col("value")
    marks = {p: value.contains(p) for p in MOJIBAKE}
    marks["both_rows"] = value.contains(";") & value.contains(",")
    marks["whitespace_count"] = has_text(value) & edge_blank(value)
    return marks


def counts_of(ds: Dataset) -> DataFrame:
    """The value counts that all checks of a data set share; ids are kept whole."""
    return value_counts(ds.df, whole=_whole(ds), marks=cell_marks())


def _whole(ds: Dataset) -> tuple[str, ...]:
    return (ds.id_column,) if ds.id_column else ()


def scan_cells(ds: Dataset, n_ids: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """``(column, kind, total, filled, n, record_ids)``: what all cell checks
    need, whatever their number. The counts come from the value counts ``freq``
    where they are at hand; one pass over the table ranks example ids."""
    marks = cell_marks()
    counted, cnt, filled, tests = cells(ds.df), F.lit(1), F.col("value").isNotNull(), marks
    if freq is not None:
        counted, cnt, filled = freq, F.col("cnt"), F.col("size").isNotNull()
        tests = {k: F.col("marks").bitwiseAND(F.lit(1 << i)) != 0 for i, k in enumerate(marks)}
    tally = lambda test: F.sum(F.when(test, cnt).otherwise(0)).cast("long")
    counts = counted.groupBy("column").agg(
        F.sum(cnt).cast("long").alias("total"), tally(filled).alias("filled"), *[tally(t).alias(k) for k, t in tests.items()]
    ).withColumn("missing", F.col("total") - F.col("filled"))
    kinds = ["missing", *marks]
    long = counts.unpivot(["column", "total", "filled"], [quoted(k) for k in kinds], "kind", "n").where(F.col("n") > 0)
    if not ds.id_column:
        return with_ids(long, long, [], n_ids, None)
    long = cut_lineage(long)  # a row per column and kind
    tests = {"missing": is_missing(F.col("value")), **marks}

    def hits(some: DataFrame) -> DataFrame:
        found = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda k: k.isNotNull())
        return some.where(reduce(lambda x, y: x | y, tests.values())).select("record_id", "column", F.explode(found).alias("kind"))

    some = cells(ds.df, ds.id_column)
    if (long.agg(F.max("n")).first()[0] or 0) > MANY_HITS:
        some = _near_cells(ds, some, hits, long, n_ids)
    return with_ids(long, hits(some), ["column", "kind"], n_ids, ds.id_column)


def _near_cells(ds: Dataset, some: DataFrame, hits: Callable[[DataFrame], DataFrame], long: DataFrame, n: int) -> DataFrame:
    """The cells that can hold one of the first ``n`` ids of some kind, so that not all hits are sorted. The ``n``-th id of
    any part of the rows is no smaller than the ``n``-th of all; a part by hash of the ids gives these bounds.
    Columns with a kind that has fewer hits in that part are searched as a whole, those without hits not at all."""
    part = ds.df.where(F.pmod(F.xxhash64(F.col(quoted(ds.id_column)).cast("string")), F.lit(PART)) == 0)
    first = first_ids(hits(cells(part, ds.id_column)), ["column", "kind"], n).where(F.size("record_ids") == n)
    bounds = long.join(F.broadcast(first), ["column", "kind"], "left").groupBy("column").agg(
        F.when(F.count("record_ids") == F.count("*"), F.max(F.array_max("record_ids"))).alias("_bound"))
    bounds = cut_lineage(bounds)  # a row per column
    return some.join(F.broadcast(bounds), "column").where(F.col("_bound").isNull() | (F.col("record_id") <= F.col("_bound"))).drop("_bound")


def _ids(n: int) -> Column:
    return F.slice("record_ids", 1, n)


def missing_severity(missing: Column) -> Column:
    return (
        F.when(missing >= 0.95, "info").when(missing >= 0.5, "warning").when(missing >= 0.1, "warning").otherwise("info")
    )


def check_missing_values(ds: Dataset, n_ids: int = 10, scan: DataFrame | None = None) -> DataFrame:
    """Columns with gaps, graded by the share of missing values."""
    scan = scan if scan is not None else scan_cells(ds)
    gap = F.col("gap")
    rows = (
        scan.where("kind = 'missing'").withColumn("rate", F.round(F.col("filled") / F.col("total"), 4))
        .withColumn("gap", F.lit(1.0) - F.col("rate")).where(F.col("n") > 0)  # the rate is rounded for output, the test is exact
    )
    words = (
        F.when(gap >= 0.95, "nearly empty").when(gap >= 0.5, "half empty").when(gap >= 0.1, "has gaps").otherwise("minor gaps")
    )
    return finding(
        rows, ds.name, ORD_MISSING, category=F.lit("missing_values"), severity=missing_severity(gap), column=F.col("column"),
        message=F.format_string("Column '%s' %s (%s)", F.col("column"), words, percent(F.col("rate"))),
        record_ids=_ids(n_ids), evidence=evidence(fill_rate=F.col("rate"), missing_count=F.col("n")),
    )


def id_counts(ds: Dataset, freq: DataFrame | None = None) -> DataFrame:
    """``(record_id, n)`` of every id, from the value counts where they are at hand."""
    if freq is not None:
        return freq.where(F.col("column") == ds.id_column).select(F.col("value").alias("record_id"), F.col("cnt").alias("n"))
    return ds.df.groupBy(F.col(quoted(ds.id_column)).cast("string").alias("record_id")).agg(F.count("*").alias("n"))


def check_duplicate_records(ds: Dataset, n_ids: int = 20, freq: DataFrame | None = None) -> DataFrame:
    """Rows that share their id; null ids count as equal. Without an id column
    the table itself is the problem."""
    if not ds.id_column:
        one = ds.df.sparkSession.range(1)
        return finding(
            one, ds.name, ORD_DUPLICATE, category=F.lit("schema_mismatch"), severity=F.lit("critical"),
            message=F.lit("No unique ID column detected"),
        )
    repeated = id_counts(ds, freq).where(F.col("n") > 1)
    # the ids are distinct here, so the few smallest are a bounded top-k
    ids = repeated.where(F.col("record_id").isNotNull()).withColumn("_one", F.lit(1))
    counted = repeated.agg(F.sum("n").alias("rows")).where(F.col("rows") > 0).withColumn("_one", F.lit(1))
    joined = with_ids(counted, ids, ["_one"], n_ids, ds.id_column)
    return finding(
        joined, ds.name, ORD_DUPLICATE, category=F.lit("duplicate_records"), severity=F.lit("critical"),
        message=F.format_string("Found %d rows with duplicate IDs", F.col("rows")), column=F.lit(ds.id_column),
        record_ids=F.col("record_ids"), evidence=evidence(duplicate_row_count=F.col("rows")),
    )


def duplicate_rows(df: DataFrame, id_column: str) -> DataFrame:
    """All rows of every repeated id. The repeated ids come from a combined
    count, so a hot id is never gathered in one task."""
    ids = df.groupBy(id_column).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    some = lookup_join(df, ids.where(F.col(id_column).isNotNull()), [id_column], "inner")
    null_count = ids.where(F.col(id_column).isNull()).select("n").first()
    if null_count:
        some = some.unionByName(df.where(F.col(id_column).isNull()).withColumn("n", F.lit(null_count[0])))
    return some


def check_encoding_issues(ds: Dataset, n_ids: int = 5, scan: DataFrame | None = None) -> DataFrame:
    """Mojibake per column and pattern, plus notes on BOM and line endings."""
    scan = scan if scan is not None else scan_cells(ds)
    out = finding(
        scan.where(F.col("kind").isin(list(MOJIBAKE))), ds.name, ORD_ENCODING,
        category=F.lit("encoding_issues"), severity=F.lit("warning"), column=F.col("column"), pattern=F.col("kind"),
        message=F.format_string(
            "Encoding artifact in '%s': %s (%d occurrences)", F.col("column"), mapped(F.col("kind"), MOJIBAKE), F.col("n")
        ),
        record_ids=_ids(n_ids), evidence=evidence(count=F.col("n")),
    )
    notes = []
    if ds.has_bom:
        notes.append("File has UTF-8 BOM")
    if ds.line_ending == "CRLF":
        notes.append("File uses Windows CRLF line endings")
    for note in notes:
        out = out.unionByName(finding(
            ds.df.sparkSession.range(1), ds.name, ORD_ENCODING, category=F.lit("encoding_issues"),
            severity=F.lit("info"), message=F.lit(note),
        ))
    return out


def check_format_inconsistency(ds: Dataset, n_ids: int = 5, scan: DataFrame | None = None) -> DataFrame:
    """Cells that mix ``;`` and ``,``, and cells with blanks at their edges."""
    scan = scan if scan is not None else scan_cells(ds)
    mixed = F.col("kind") == "both_rows"
    message = F.when(
        mixed, F.format_string("Column '%s' uses mixed delimiters (;  and ,) in %d rows", F.col("column"), F.col("n"))
    ).otherwise(F.format_string("Column '%s' has leading/trailing whitespace in %d values", F.col("column"), F.col("n")))
    return finding(
        scan.where(F.col("kind").isin("both_rows", "whitespace_count")), ds.name, ORD_FORMAT,
        category=F.lit("format_inconsistency"), severity=F.lit("warning"), column=F.col("column"), message=message,
        pattern=F.col("kind"), record_ids=_ids(n_ids), evidence=F.create_map(F.col("kind"), F.col("n").cast("double")),
    )


def _terms(values: DataFrame) -> DataFrame:
    return values.where(has_text(F.col("value"))).select("column", "cnt", F.explode(split_terms(F.col("value"))).alias("form"))


def variant_groups(freq: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Spellings that differ only in case: ``(column, canonical, pairs)``, the
    pairs being (form, cnt). Columns of any number of values take part; a group holds
    the spellings of one term.

    ``more`` are long cells, as ``(column, value)``, whose values ``freq`` does not hold. Their terms
    can be as long: terms above ``SHORT`` are counted by hash, and only those with several
    spellings are fetched, in a second pass where there are any."""
    terms = _terms(freq)
    if more is None:
        spelled = terms.groupBy("column", "form").agg(F.sum("cnt").alias("cnt"))
    else:
        terms = terms.union(_terms(more.withColumn("cnt", F.lit(1).cast("long"))))
        short = F.length(F.lower("form")) <= SHORT  # the same for all spellings of a term
        digest = lambda c: F.when(~short, F.unhex(F.md5(c)))
        keyed = terms.select("column", "cnt", F.when(short, F.col("form")).alias("form"), digest(F.lower("form")).alias("term"), digest(F.col("form")).alias("spelling"))
        forms = cut_lineage(keyed.groupBy("column", "form", "term", "spelling").agg(F.sum("cnt").alias("cnt")))
        spelled = forms.where(F.col("form").isNotNull()).select("column", "form", "cnt")
        several = cut_lineage(forms.where(F.col("form").isNull()).groupBy("column", "term").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("column", "term"))
        if not several.isEmpty():
            long = terms.where(~short).withColumn("term", F.unhex(F.md5(F.lower("form"))))
            spelled = spelled.union(lookup_join(long, several, ["column", "term"], "left_semi").groupBy("column", "form").agg(F.sum("cnt").alias("cnt")))
    return spelled.groupBy("column", F.lower("form").alias("canonical")).agg(
        F.array_sort(F.collect_list(F.struct("form", "cnt"))).alias("pairs")
    ).where(F.size("pairs") > 1)


def long_values(ds: Dataset, freq: DataFrame) -> DataFrame | None:
    """Cells with long values, or None where the counts know of none."""
    some = freq.where((F.col("size") > SHORT) & F.col("value").isNull()).limit(1)
    return None if some.isEmpty() else long_cells(ds.df, _whole(ds))


def variant_rows(groups: DataFrame) -> DataFrame:
    """``(column, canonical, form, cnt, forms)``: one row per spelling."""
    return groups.select("column", "canonical", F.size("pairs").cast("long").alias("forms"), F.explode("pairs").alias("p")).select(
        "column", "canonical", "p.form", "p.cnt", "forms"
    )


def check_term_variants(ds: Dataset, n_examples: int = 5, freq: DataFrame | None = None) -> DataFrame:
    freq = counts_of(ds) if freq is None else freq
    groups = cut_lineage(variant_groups(freq, long_values(ds, freq)))
    example = F.struct("canonical", F.col("pairs.form").alias("forms"), F.col("pairs.cnt").alias("counts"))
    first = top_rows(groups, ["column"], [F.col("canonical")], n_examples).groupBy("column").agg(F.array_sort(F.collect_list(example)).alias("examples"))
    counted = groups.groupBy("column").agg(F.count("*").alias("n")).join(first, "column")  # one row per column on both sides
    return finding(
        counted, ds.name, ORD_VARIANTS, category=F.lit("term_variants"), severity=F.lit("warning"), column=F.col("column"),
        message=F.format_string("Column '%s' has %d term variant groups", F.col("column"), F.col("n")),
        evidence=evidence(variant_count=F.col("n")), examples=F.col("examples"),
        suggestion=F.lit("Normalize to consistent form before export"),
    )


def authority_coverage(df: DataFrame) -> DataFrame:
    """One row of slot counts over all authority id and reasoning columns."""
    ids = [c for c in df.columns if "gnd_id" in c.lower()]
    reasons = [c for c in df.columns if "begruendung" in c.lower()]

    def total(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))

    def remark(text: str) -> Column:
        return total([F.count_if(F.lower(quoted_col(c)).contains(text.lower())) for c in reasons])

    def quoted_col(c: str) -> Column:
        return F.col(quoted(c)).cast("string")

    return df.agg(
        (F.count("*") * len(ids)).alias("total_ne_slots"),
        total([F.count_if(has_text(quoted_col(c))) for c in ids]).alias("filled_gnd_ids"),
        remark(NO_MATCH_REMARK).alias("no_match_count"),
        remark(LOOKUP_REMARK).alias("api_recommended"),
    )


def check_authority_coverage(ds: Dataset) -> DataFrame:
    if not any("gnd_id" in c.lower() for c in ds.df.columns):
        return ds.df.sparkSession.createDataFrame([], FINDING)
    row = authority_coverage(ds.df).where(F.col("total_ne_slots") > 0)
    coverage = F.col("filled_gnd_ids") / F.col("total_ne_slots")
    return finding(
        row, ds.name, ORD_AUTHORITY, category=F.lit("gnd_match_missing"),
        severity=F.when(coverage < 0.5, "warning").otherwise("info"),
        message=F.format_string("GND coverage: %d/%d slots (%s)", F.col("filled_gnd_ids"), F.col("total_ne_slots"), percent(coverage)),
        evidence=evidence(
            total_ne_slots=F.col("total_ne_slots"), filled_gnd_ids=F.col("filled_gnd_ids"), coverage_rate=F.round(coverage, 4),
            no_match_count=F.col("no_match_count"), api_recommended=F.col("api_recommended"),
        ),
        suggestion=F.format_string("%d entries recommend API lookup", F.col("api_recommended")),
    )


def id_membership(datasets: list[Dataset], freqs: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per id with a flag per dataset; one shuffle for any number of
    datasets, and repeated ids collapse in the map-side combine."""
    tagged = reduce(DataFrame.unionByName, [
        (id_counts(d, freqs[d.name]).select("record_id", F.lit(i).alias("_ds")) if freqs else
         d.df.select(F.col(quoted(d.id_column)).cast("string").alias("record_id"), F.lit(i).alias("_ds"))) for i, d in enumerate(datasets)
    ]).where(F.col("record_id").isNotNull())
    return tagged.groupBy("record_id").agg(*[F.max(F.col("_ds") == i).alias(f"in_{i}") for i in range(len(datasets))])


def linkage_counts(datasets: list[Dataset], members: DataFrame | None = None) -> DataFrame:
    """Per ordered pair of datasets: shared ids and ids only on the left side."""
    members = id_membership(datasets) if members is None else members
    pairs = [(i, j) for i in range(len(datasets)) for j in range(i + 1, len(datasets))]
    sums = []
    for i, j in pairs:
        a, b = F.col(f"in_{i}"), F.col(f"in_{j}")
        sums += [
            F.count_if(a & b).alias(f"shared_{i}_{j}"), F.count_if(a & ~b).alias(f"left_{i}_{j}"), F.count_if(b & ~a).alias(f"right_{i}_{j}")
        ]
    rows = F.array(*[
        F.struct(
            F.lit(datasets[i].name).alias("a"), F.lit(datasets[j].name).alias("b"), F.col(f"shared_{i}_{j}").alias("shared_count"),
            F.col(f"left_{i}_{j}").alias("only_in_a"), F.col(f"right_{i}_{j}").alias("only_in_b"),
        )
        for i, j in pairs
    ])
    return members.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def orphans(datasets: list[Dataset], members: DataFrame | None = None) -> DataFrame:
    """``(source, target, record_id)`` for every id without a match."""
    members = id_membership(datasets) if members is None else members
    marks = F.array(*[
        F.when(F.col(f"in_{i}") & ~F.col(f"in_{j}"), F.struct(F.lit(a.name).alias("source"), F.lit(b.name).alias("target")))
        for i, a in enumerate(datasets) for j, b in enumerate(datasets) if i != j
    ])
    return members.select("record_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select("m.source", "m.target", "record_id")


def check_linkage(datasets: list[Dataset], n_ids: int = 10, freqs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Orphans in both directions and shared ids, for each pair of datasets."""
    datasets = [d for d in datasets if d.id_column]
    spark = SparkSession.getActiveSession()
    if len(datasets) < 2:
        return spark.createDataFrame([], FINDING)
    members = cut_lineage(id_membership(datasets, freqs))
    counts = linkage_counts(datasets, members)
    ids = first_ids(orphans(datasets, members), ["source", "target"], n_ids)
    sides = counts.select(
        "shared_count",
        F.explode(F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.col("only_in_a").alias("n")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("target"), F.col("only_in_b").alias("n")),
        )).alias("s"),
    ).select("shared_count", "s.*").where(F.col("n") > 0)
    orphan = finding(
        sides.join(F.broadcast(ids), ["source", "target"], "left"), "", ORD_LINKAGE,
        category=F.lit("orphan_records"), severity=F.lit("warning"), record_ids=F.col("record_ids"), dataset=F.col("source"),
        message=F.format_string("%d records in '%s' have no match in '%s'", F.col("n"), F.col("source"), F.col("target")),
        evidence=evidence(orphan_count=F.col("n"), shared_count=F.col("shared_count")),
    )
    shared = finding(
        counts.where(F.col("shared_count") > 0), "", ORD_LINKAGE, category=F.lit("cross_file_mismatch"), severity=F.lit("info"),
        dataset=F.col("a"), message=F.format_string("'%s' and '%s' share %d record IDs", F.col("a"), F.col("b"), F.col("shared_count")),
        evidence=evidence(shared_count=F.col("shared_count"), only_in_a=F.col("only_in_a"), only_in_b=F.col("only_in_b")),
    )
    return orphan.unionByName(shared)


def run_checks(datasets: list[Dataset], freqs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Findings of all checks on all datasets, and of the links between them.

    Each dataset is read twice: once for its value counts, from which come all
    numbers, repeated ids, variants and links, and once for example ids. Both results
    are written, so that no check repeats them. ``freqs`` passes value counts that are
    there already.
    """
    frames = []
    freqs = freqs or {d.name: cut_lineage(counts_of(d)) for d in datasets}
    for i, d in enumerate(datasets):
        freq = freqs[d.name]
        scan = cut_lineage(scan_cells(d, freq=freq))
        found = [
            check_missing_values(d, scan=scan), check_duplicate_records(d, freq=freq), check_encoding_issues(d, scan=scan),
            check_format_inconsistency(d, scan=scan), check_term_variants(d, freq=freq), check_authority_coverage(d),
        ]
        frames += [f.withColumn("ord", F.col("ord") + 10 * i) for f in found]
    if len(datasets) > 1:
        frames.append(check_linkage(datasets, freqs=freqs).withColumn("ord", F.col("ord") + 10 * len(datasets)))
    return reduce(DataFrame.unionByName, frames)


def profiles(datasets: list[Dataset], freqs: dict[str, DataFrame] | None = None) -> DataFrame:
    frames = [
        column_profile(freqs[d.name] if freqs else value_counts(d.df)).withColumn("dataset", F.lit(d.name))
        for d in datasets
    ]
    return reduce(DataFrame.unionByName, frames)


def analyze(datasets: list[Dataset]) -> tuple[DataFrame, DataFrame]:
    """(findings, profile), both materialised. The value counts, the only
    data-sized intermediate, are written once and read by all."""
    freqs = {d.name: cut_lineage(counts_of(d)) for d in datasets}
    return cut_lineage(run_checks(datasets, freqs)), cut_lineage(profiles(datasets, freqs))
