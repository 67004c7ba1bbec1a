"""Row reshaping helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, split_values, strip
from .profile import quoted


def split_multivalued(df: DataFrame, columns: list[str], sep: str = ";") -> DataFrame:
    """One row per value of each listed column, one column after the other; a
    cell without values stays as null. Unknown columns are skipped."""
    for c in columns:
        if c in df.columns:
            df = df.withColumn(c, F.explode_outer(split_values(F.col(quoted(c)), sep)))
    return df


def record_context(columns: list[str], skip: str = "", n: int = 8) -> Column:
    """Map of the first ``n`` other non-empty cells of a row."""
    pairs = [F.struct(F.lit(c).alias("key"), strip(F.col(quoted(c)).cast("string")).alias("value")) for c in columns if c != skip]
    filled = F.filter(F.array(*pairs), lambda p: has_text(p["value"]))
    return F.map_from_entries(F.slice(filled, 1, n))


def row_text(columns: list[str], sep: str = "; ", size: int | None = None) -> Column:
    """Non-empty cells of a row as one text for a prompt, whole or its first ``size`` characters."""
    cells = [F.nullif(strip(F.col(quoted(c)).cast("string")), F.lit("")) for c in columns]
    text = F.concat_ws(sep, *cells)
    return text if size is None else F.substring(text, 1, size)
