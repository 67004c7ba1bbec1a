"""Fill-in-middle: texts cut at unit borders and put together again around markers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts

#: One unit in the bytes of UTF-8: a run of letters A to Z, or any one other character.
UNIT = rb"([A-Za-z]+|[\x00-\x7f]|[\xc2-\xf4][\x80-\xbf]*)"
#: A byte that UTF-8 never holds ends each unit.
END = b"\xff"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKER = rb"<[PSM]>"
SLICE = 4 << 20

TRANSFORMED = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Start and number of rows that hold about ``limit`` bytes together; a longer row stands alone."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, stop - at
        at = stop


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _any(*masks: pa.Array) -> pa.Array:
    out = masks[0]
    for mask in masks[1:]:
        out = pc.or_(out, mask)
    return out


def _rebuilt(flat: pa.Array, mask: pa.Array, sizes: pa.Array) -> pa.Array:
    """The units under a mask as one list for each text, joined."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes.to_numpy(zero_copy_only=False), out=offsets[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat.filter(mask)), b"")


def transform(text: pa.Array, h: list[pa.Array], plain_from: int, spm_below: int) -> list[pa.Array]:
    """n, form, characters of prefix and middle, and output, for a column of bytes and four numbers a row."""
    units = pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT, replacement=rb"\1" + END), pattern=END)
    n = pc.cast(pc.subtract(pc.list_value_length(units), 1), pa.int64())  # nothing follows the last end
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    first = pc.take(units.offsets, parent)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.cast(first, pa.int64()))
    one, other = (_modulo(x, pc.add(n, 1)) for x in h[:2])
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    before, behind = pc.less(ordinal, pc.take(low, parent)), pc.greater_equal(ordinal, pc.take(high, parent))
    prefix = _rebuilt(flat, before, low)
    middle = _rebuilt(flat, pc.and_not(pc.invert(before), behind), pc.subtract(high, low))
    suffix = _rebuilt(flat, behind, pc.add(pc.subtract(n, high), 1))
    plain = _any(pc.equal(n, 0), *[pc.match_substring(text, pattern=m) for m in (PREFIX, SUFFIX, MIDDLE)],
                 pc.greater_equal(_modulo(h[2], 100), plain_from))
    spm = pc.less(_modulo(h[3], 100), spm_below)
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, b"")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, b"")
    length = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(pc.cast(p, pa.string())), pa.int64())) for p in (prefix, middle)]
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    return [n, form, *length, pc.cast(pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text)), pa.string())]


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: str = "1:", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row.

    A text is cut into units (a run of letters A to Z, or any one other character). Four
    numbers from the sha256 of ``seed`` and id choose both borders and the form, so a
    repeated row or a lost task gives the same result. Texts that hold a marker, empty
    ones and a share of ``100 - plain_from`` percent stay ``plain``; of the others
    ``spm_below`` percent put the suffix first (``spm``), the rest the prefix (``psm``).

    Per slice of some megabytes of a batch: units as list arrays, flattened with the row they
    come from, their ordinals in it, a filter by part, lists again, and one join per part.
    A text of any length is one row of such a slice. A null text counts as empty; a null
    id is hashed as the seed alone. Nothing is shuffled."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in slices(batch.column(1)):
                part = batch.slice(at, count)
                text = pa.concat_arrays([part.column(1)]).cast(pa.binary())
                out = transform(text, [part.column(i) for i in range(2, 6)], plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([part.column(0), *out], [c.split()[0] for c in TRANSFORMED.split(", ")])

    return texts(docs, id_col, text_col).select("id", "text", *numbers).mapInArrow(run, TRANSFORMED)


def restore(form: pa.Array, output: pa.Array) -> pa.Array:
    """The texts from their outputs: the first markers of each are the ones put there."""
    moved = pc.not_equal(form, "plain")
    if not pc.any(moved).as_py():
        return output
    parts = pc.split_pattern_regex(output.filter(moved).cast(pa.binary()), pattern=MARKER)
    one, two, middle = (pc.list_element(parts, i) for i in (1, 2, 3))
    spm = pc.equal(form.filter(moved), "spm")
    text = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), b"")
    return pc.replace_with_mask(output, moved, pc.cast(text, output.type))


def restored(found: DataFrame) -> DataFrame:
    """Rows of :func:`fill_in_middle` with the text they came from as ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output = batch.schema.get_field_index("output")
            for at, count in slices(batch.column(output)):
                part = batch.slice(at, count)
                text = restore(part.column("form"), pa.concat_arrays([part.column(output)]))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "text"])

    return found.mapInArrow(run, TRANSFORMED + ", text string")


_DIGITS = ", ".join(f"cast('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
#: The same rows in DuckDB; the text itself stands for the restored one.
OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, u, cast(len(u) AS BIGINT) AS n, {_DIGITS} FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


def op12(spark, sf_dir: str) -> DataFrame:
    found = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
