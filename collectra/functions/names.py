"""Personal names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_blanks, strip

# FIXED VALUES: particles that belong to the surname.
PARTICLES = [
    "von", "vom", "zu", "zur", "van", "ten", "ter", "der",
    "de", "du", "des", "le", "la",
    "del", "della", "di", "da", "dal", "dalla", "lo", "los", "las",
]


def parse_name(c: Column) -> Column:
    """struct<firstname, lastname>. ``Last, First`` splits at the comma; else
    the surname is the last word with the run of particles before it."""
    comma = c.contains(",")
    words = collapse_blanks(c)
    surname = rf"(?iu)(?:^|\s)((?:(?:{'|'.join(PARTICLES)})\s+)*\S+)$"
    last = F.regexp_extract(words, surname, 1)
    first = strip(F.substring(words, F.lit(1), F.length(words) - F.length(last)))
    return F.struct(
        F.when(comma, strip(F.regexp_replace(c, r"(?s)^[^,]*,", ""))).otherwise(first).alias("firstname"),
        F.when(comma, strip(F.substring_index(c, ",", 1))).otherwise(last).alias("lastname"),
    )
