"""What the exports share: per-row lookups, bounded groups, text files."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, xml_escape
from ..operators.joins import fits_broadcast, lookup_join
from ..operators.profile import quoted
from ..session import cut_lineage


def collected(rows: DataFrame, keys: str | list[str], order: str, fields: list[str], out: str) -> DataFrame:
    """``(keys, out)`` with the ordered rows of each key as an array of structs:
    all that one exported document holds."""
    keys = [keys] if isinstance(keys, str) else keys
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_ord"), *fields))).alias(out))


def row_key(columns: list[str]) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(quoted(c)).cast("string").alias(c) for c in columns]))))


def with_row_hits(
    df: DataFrame, columns: list[str], parts: Column, lookup: DataFrame, keys: list[str], value: str, out: str, sparse: bool = False
) -> DataFrame:
    """Add a map from the parts of a row to what a lookup table says about
    them. ``parts`` is an array of structs with the fields ``keys`` and
    ``name``; the map is ``name -> value``. Rows are matched back by a hash of
    their content, so the map of a row holds that row's parts only.

    The rows are written first: the search, the counts of the joins and the result read them, and what led to them
    is not worked out for each. ``sparse`` says that few parts are known: a large lookup is then reduced to parts that occur
    before the parts of all rows are shuffled."""
    rows = cut_lineage(df.withColumn("_row", row_key(columns)))
    exploded = rows.select("_row", F.explode(parts).alias("_p")).select("_row", "_p.*")
    known = cut_lineage(lookup.select(*keys, value))
    if sparse and not fits_broadcast(known):
        known = known.join(exploded.select(*keys).distinct(), keys, "left_semi")
    hits = lookup_join(exploded, known, keys, "inner")
    maps = hits.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("name", value))).alias(out))
    return lookup_join(rows, maps, ["_row"], "left").drop("_row")


def gnd_lookup(terms: DataFrame) -> DataFrame:
    """``(part, gnd_id)`` of dictionary terms that have an authority id. The
    first entry of a term wins."""
    return terms.where("gnd_id <> ''").groupBy(F.lower("term").alias("part")).agg(F.min_by("gnd_id", "ord").alias("gnd_id"))


def element(name: str, attributes: list[tuple[str, Column | str]], text: Column | None = None, extra: Column | None = None) -> Column:
    """An XML element as text; ``extra`` is ready-made attribute text."""
    head = [F.lit(f"<{name}")]
    for key, value in attributes:
        v = F.lit(value) if isinstance(value, str) else value
        head += [F.lit(f' {key}="'), xml_escape(F.coalesce(v, F.lit(""))), F.lit('"')]
    if extra is not None:
        head.append(extra)
    if text is None:
        return F.concat(*head, F.lit(" />"))
    return F.concat(*head, F.lit(">"), text, F.lit(f"</{name}>"))


def cell(column: str) -> Column:
    """Stripped cell, null when empty."""
    return F.nullif(strip(F.col(quoted(column)).cast("string")), F.lit(""))


#: A document ends after so many lines of about so many characters, some 32 MB in all.
LINES, LINE_SIZE = 64, 1 << 19
#: The head of a document, the text of a row, the tail.
Document = Callable[[], tuple[str, Callable[..., str], Callable[[], str]]]


def write_bounded(rows: DataFrame, path: str, document: Document, compression: str = "none") -> None:
    """One valid document per part file, and as many as the rows fill: readers give a whole XML file to one
    task. ``document`` is called for each. Rows are put together to lines of ``LINE_SIZE``;
    every document but the last of a task has ``LINES`` of them, which is where the writer begins a file.
    Documents that only Spark reads again can be written with ``gzip``; markup repeats, so little of it is left on disk."""
    most, size = LINES, LINE_SIZE

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["\n".join(texts)], pa.string())], ["value"])

        head, text, tail = document()
        line, filled, lines, begun = [head], 0, 0, True
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun:
                    head, text, tail = document()
                    line, filled, lines, begun = [head], 0, 0, True
                line.append(text(*row))
                filled += len(line[-1])
                if filled < size:
                    continue
                lines += 1
                begun = lines < most
                yield out(line if begun else [*line, tail()])
                line, filled = [], 0
        if begun:
            yield out([*line, tail()])

    rows.mapInArrow(wrap, "value string").write.mode("overwrite").options(maxRecordsPerFile=most, compression=compression).text(path)


def write_documents(xml: DataFrame, path: str, head: str, tail: str, column: str = "xml", between: str = "", compression: str = "none") -> None:
    """Documents of bounded size, one per part file: head, the records with ``between`` in front of all but the first, tail."""
    def document():
        first = True

        def text(value: str | None) -> str:
            nonlocal first
            front, first = "" if first else between, False
            return front + (value or "")

        return head, text, lambda: tail

    write_bounded(xml.select(column), path, document, compression)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, bom: bool = False) -> None:
    """CSV with header; with ``bom`` every part starts with a byte order mark."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, quoteAll=quote_all, escape='"', **keep_blanks).csv(path)
