"""Facts about input files from their first bytes."""
from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 8192
# FIXED VALUES: byte order marks.
BOMS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
SPARK_NAMES = {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}
DELIMITERS = [",", ";", "\t", "|"]


def _walk(spark: SparkSession, path: str) -> Iterator[tuple[str, int]]:
    """(path, length) of every file below a path. A local folder is listed by Python, since the walk through
    Hadoop costs some calls into the JVM for each file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    root = fs.makeQualified(hadoop).toUri()
    if root.getScheme() == "file":
        folders = [root.getPath()]
        if os.path.isfile(folders[0]):
            yield f"file:{folders[0]}", os.path.getsize(folders.pop())
        while folders:
            with os.scandir(folders.pop()) as entries:
                for entry in entries:
                    if entry.is_dir():
                        folders.append(entry.path)
                        continue
                    try:
                        yield f"file:{entry.path}", entry.stat().st_size
                    except FileNotFoundError:  # removed meanwhile
                        pass
        return
    walk = fs.listFiles(hadoop, True)
    while walk.hasNext():
        status = walk.next()
        yield status.getPath().toString(), status.getLen()


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), only_empty: bool = False) -> list[str]:
    """Data files below a path, or those of them without content; only names come to the driver."""
    found = []
    for file, length in _walk(spark, path):
        name = file.rpartition("/")[2]
        if not (only_empty and length) and not name.startswith(("_", ".")) and (not suffixes or name.lower().endswith(suffixes)):
            found.append(file)
    return sorted(found)


def head(spark: SparkSession, file: str, n: int = HEAD_BYTES) -> bytes:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        bounded = spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def unpacked_head(file: str, raw: bytes) -> bytes:
    """The first bytes of what Spark reads from a file: it unpacks one named .gz."""
    if not file.endswith(".gz"):
        return raw
    try:
        return zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(raw, HEAD_BYTES)
    except zlib.error as e:
        raise ValueError(f"{file} is not a gzip file") from e


def encoding_of(raw: bytes) -> tuple[str, bool, str | None]:
    """(encoding, has BOM, warning) of the first bytes of a file."""
    for mark, name in BOMS.items():
        if raw.startswith(mark):
            return name, True, None
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(raw)  # a character cut off at the end is fine
        return "utf-8", False, None
    except UnicodeDecodeError:
        pass
    try:
        raw.decode("cp1252")
        return "cp1252", False, "not UTF-8; read as cp1252"
    except UnicodeDecodeError:
        return "latin-1", False, "neither UTF-8 nor cp1252; read as latin-1"


def delimiter_of(text: str) -> str:
    """The candidate that occurs equally often, outside quotes, in every line."""
    plain = re.sub(r'"(?:[^"]|"")*"', "", text)
    lines = [line for line in plain.splitlines() if line.strip()]
    if len(lines) > 1 and not plain.endswith(("\n", "\r")):
        lines = lines[:-1]
    counts = {d: [line.count(d) for line in lines] for d in DELIMITERS}
    even = {d: c[0] for d, c in counts.items() if c and c[0] > 0 and len(set(c)) == 1}
    return max(even, key=lambda d: even[d]) if even else ","


def line_ending_of(raw: bytes) -> str:
    return "CRLF" if b"\r\n" in raw else "LF" if b"\n" in raw else ""


def facts_of(raw: bytes) -> dict:
    encoding, bom, warning = encoding_of(raw)
    text = raw.decode("utf-8-sig" if encoding == "utf-8" else encoding, errors="replace").lstrip("﻿")
    first, more, _ = text.partition("\n")
    return {
        "encoding": encoding, "has_bom": bom, "warning": warning or "", "delimiter": delimiter_of(text[:4096]), "line_ending": line_ending_of(raw),
        "crlf": first.endswith("\r") and bool(more),
        "header": first.rstrip("\r") if more or len(raw) < HEAD_BYTES else None,  # None: longer than what was read
    }


def file_facts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> list[dict]:
    """Facts per file, with its path."""
    files = list_files(spark, path, suffixes)
    with ThreadPoolExecutor(16) as pool:  # some kilobytes per file, never whole files
        return list(pool.map(lambda f: {"path": f, **facts_of(head(spark, f))}, files))


def root_format(raw: bytes) -> str:
    """mets_mods, mods, lido or unknown, from the root element."""
    match = re.search(r"<(?:([\w.\-]+):)?([\w.\-]+)([^>]*)>", re.sub(r"<!--.*?-->|<\?.*?\?>|<![^>]*>", "", raw.decode("utf-8", "replace"), flags=re.S))
    if not match:
        raise ValueError("no XML element found")
    prefix, name, rest = match.groups()
    spaces = dict(re.findall(r'xmlns(?::([\w.\-]+))?="([^"]*)"', rest))
    space = spaces.get(prefix or "", "")
    if name == "mets" or space == "http://www.loc.gov/METS/":
        return "mets_mods"
    if name in ("mods", "modsCollection") or space == "http://www.loc.gov/mods/v3":
        return "mods"
    if name in ("lido", "lidoWrap") or space == "http://www.lido-schema.org":
        return "lido"
    return "unknown"


def xml_formats(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The XML files below a path by format; ``unknown`` also takes what has no element."""
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)

    def kind(file: str) -> str:
        try:
            return root_format(unpacked_head(file, head(spark, file)))
        except ValueError:
            return "unknown"

    with ThreadPoolExecutor(16) as pool:
        kinds = list(pool.map(kind, files))
    out: dict[str, list[str]] = {}
    for name, f in zip(kinds, files):
        out.setdefault(name, []).append(f)
    return out


def xml_format(spark: SparkSession, path: str) -> str:
    """The format of a file, or of all files of a folder; an error if they differ."""
    found = xml_formats(spark, path)
    if len(found) > 1:
        raise ValueError(f"{path} holds files of several formats: {sorted(found)}")
    return next(iter(found))


def preview(spark: SparkSession, path: str, rows: int = 10) -> tuple[dict, DataFrame]:
    """(facts and columns of a CSV, its first rows) without loading the file."""
    facts = file_facts(spark, path)[0]
    df = spark.read.options(header=True, sep=facts["delimiter"], encoding=SPARK_NAMES[facts["encoding"]]).csv(facts["path"]).limit(rows)
    return {**facts, "columns": [c.lstrip("﻿") for c in df.columns]}, df
