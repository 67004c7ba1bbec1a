"""URL filter: host and path rules, then boosted trees on lexical features.

Everything here is a column expression; the trees are fitted by the boosting
of ``pyspark.ml`` on DataFrames and written back as one CASE expression."""
from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

#: (verdict, host, path); a rule also fits the subdomains of its host.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "host_entropy",
    "parameters", "fragment", "secure", "extension", "suffix_rows", "suffix_allowed", "site_rows", "site_allowed", "folder_rows",
    "folder_allowed",
]
PARTS = ("suffix", "site", "folder")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, else null. The rules are
    literals of the plan: a CASE, longest rule first. Among rules of equal
    text, the first given holds."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    return F.coalesce(-F.aggregate(
        chars, F.lit(0.0),
        lambda acc, c: acc + F.when(c == "", 0.0).otherwise(
            (lambda p: p * F.log2(p))((size - F.length(F.replace(text, c, F.lit("")))) / size))), F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features to rows with ``url``, ``host`` and ``path``, and the
    ``suffix`` (last label of the host), ``site`` (last two) and ``folder`` (first part of the path)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = lambda c: (F.length(c) - F.length(F.translate(c, "0123456789", ""))) / F.greatest(F.length(c), F.lit(1))
    as_double = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")), "labels": F.size(F.split(host, r"\.")),
        "digits": digits(url), "host_digits": digits(host), "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.instr(url, "#") > 0, "secure": url.startswith("https:"), "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"),
    }
    return pages.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in as_double.items()}).withColumns({
        "suffix": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2), "folder": F.regexp_extract(path, "^/([^/]*)", 1)})


def _tree(text: list[str], at: int = 0) -> tuple[Column, int]:
    """A fitted tree's printed form as a CASE expression, and the lines it took."""
    line = text[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    feature, value = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes, at = _tree(text, at + 1)
    no, at = _tree(text, at + 1)  # past the line "Else"
    return F.when(F.col(FEATURES[int(feature)]) <= float(value), yes).otherwise(no), at


def boosted(examples: DataFrame, rounds: int, depth: int) -> Column:
    """The margin of boosted trees fitted on rows with the features and ``label``."""
    ready = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(examples)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=17).fit(ready)
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + _tree(tree.toDebugString.splitlines()[1:])[0] * F.lit(float(weight))
    return total


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", rounds: int = 12, depth: int = 3, examples: int = 20_000) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row.

    A fitting rule decides; the rows that rules decide are the labelled URLs from
    which the trees learn, and the trees decide the rest. Suffix, site and
    folder statistics count all labelled rows; each row is left out of its own. The trees
    are fitted on at most ``examples`` labelled rows, those with the smallest
    hashes of their URLs. A null URL, or one without ``://``, has empty host and
    path. If all labelled rows have one verdict, or there are none, the rest gets
    that verdict, or ``allow``."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "hit.*")
    rows = lexical(rows.withColumnRenamed("verdict", "ruled")).withColumn("label", (F.col("ruled") == "allow").cast("double"))
    tallies = {}
    for part in PARTS:
        tallies[part] = cut_lineage(rows.where("label is not null").groupBy(part).agg(
            F.count("*").cast("double").alias(f"{part}_n"), F.sum("label").alias(f"{part}_sum")))
    totals = tallies["suffix"].agg(F.sum("suffix_n"), F.sum("suffix_sum")).first()
    n, allowed = totals[0] or 0.0, totals[1] or 0.0
    own = F.coalesce(F.col("label"), F.lit(0.0))
    counted = F.when(F.col("label").isNull(), 0.0).otherwise(1.0)
    for part in PARTS:
        rows = rows.join(tallies[part], part, "left").withColumns({
            f"{part}_rows": F.log1p(F.coalesce(f"{part}_n", F.lit(0.0)) - F.when(F.col(f"{part}_n").isNull(), 0.0).otherwise(counted)),
            f"{part}_allowed": (F.coalesce(f"{part}_sum", F.lit(0.0)) - F.when(F.col(f"{part}_n").isNull(), 0.0).otherwise(own) + 1)
            / (F.coalesce(f"{part}_n", F.lit(0.0)) - F.when(F.col(f"{part}_n").isNull(), 0.0).otherwise(counted) + 2)})
    if 0 < allowed < n:
        sample = cut_lineage(rows.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(examples).select(*FEATURES, "label"))
        method = F.when(boosted(sample, rounds, depth) > 0, "allow").otherwise("block") if _both(sample) else None
    else:
        method = None
    if method is None:
        method = F.lit("block" if n and not allowed else "allow")
    return rows.select("id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def _both(sample: DataFrame) -> bool:
    low, high = sample.agg(F.min("label"), F.max("label")).first()
    return low != high


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
