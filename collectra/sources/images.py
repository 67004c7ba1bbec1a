"""Image folders as tables of technical facts."""
from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import list_files

# FIXED VALUES: file types by extension, and by leading bytes.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp"}
MAGIC = {"ffd8ff": "image/jpeg", "89504e470d0a1a0a": "image/png", "49492a00": "image/tiff", "4d4d002a": "image/tiff"}
#: What is read of a JPEG file for its frame header, first and where that was not enough.
NEAR, HEAD = 1 << 12, 1 << 20
#: Spark holds a file in one row of at most this many bytes.
LARGEST = (1 << 31) - 1 - 64
#: So many of Spark's file splits, which hold some 32 small files each, are read by one task where files are small.
SPLITS, SMALL_SPLIT = 8, 1 << 24
SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def mime_type(path: Column, content: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    out = F.lit("application/octet-stream")
    for magic, name in MAGIC.items():
        out = F.when(F.lower(F.hex(F.substring(content, 1, len(magic) // 2))) == magic, name).otherwise(out)
    for suffix, name in MIME.items():
        out = F.when(ext == suffix, name).otherwise(out)
    return out


# Frame headers are SOF0 to SOF15, without DHT, JPG and DAC, which lie among them.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# Markers without a length: TEM, the restarts, and the start and end of an image.
BARE = frozenset({0x01, *range(0xD0, 0xDA)})


def jpeg_frame(data: bytes) -> tuple[int | None, int | None]:
    """(width, height) by the first frame header. Fill bytes before a marker are
    passed over; image data, an end of image or a cut file end the search."""
    stream = io.BytesIO(data)
    while True:
        byte = stream.read(1)
        if byte != b"\xff":
            return None, None
        while byte == b"\xff":
            byte = stream.read(1)
        if not byte or byte in (b"\xd9", b"\xda"):
            return None, None
        if byte[0] in BARE:
            continue
        length = int.from_bytes(stream.read(2), "big")
        if byte[0] in FRAMES:
            frame = stream.read(5)  # precision, height, width
            return (int.from_bytes(frame[3:], "big"), int.from_bytes(frame[1:3], "big")) if len(frame) == 5 else (None, None)
        stream.seek(max(length - 2, 0), io.SEEK_CUR)


@F.pandas_udf(SIZE)
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    sizes = [jpeg_frame(c) if c is not None else (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


def _fewer_tasks(files: DataFrame) -> DataFrame:
    """Splits of small files together, since each task with Python costs more than reading them; splits of many bytes stay alone."""
    splits, size = files.select("path").rdd.getNumPartitions(), int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(-(-splits // SPLITS), 4 * files.sparkSession.sparkContext.defaultParallelism)
    return files.coalesce(wanted) if wanted < splits and size < splits * SMALL_SPLIT else files


def scan_images(spark: SparkSession, path: str, with_content: bool = False, largest: int = LARGEST) -> DataFrame:
    """One row per image below a folder, in any case with its path. ``errors`` says why a file has no facts: it
    cannot be read, is empty, or is above ``largest`` bytes, which one row cannot hold; its type is then ``unknown``.

    The listing does not open files; contents are read apart, without the files that are too
    large, so that one bad file costs only itself. A file that is removed meanwhile has no row. Sizes of PNG files and hashes are computed in the
    JVM; only the first part of JPEG files goes to Python, and all of it only where
    the frame header lies behind long metadata."""
    globs = "*.{jpg,jpeg,png,tif,tiff,webp,JPG,JPEG,PNG,TIF,TIFF,WEBP}"
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=globs, ignoreMissingFiles=True, ignoreCorruptFiles=True).load(path)
    files = _fewer_tasks(files)
    listed = files.select("path", "length")
    empty = list_files(spark, path, tuple(MIME), only_empty=True)  # which the reader passes over
    if empty:
        listed = listed.unionByName(spark.createDataFrame([(f, 0) for f in empty], "path string, length long"))
    read = files.where(F.col("length") <= largest)
    c = F.col("content")
    typed = read.select("path", c, F.col("length").alias("size_bytes"), mime_type(F.col("path"), c).alias("mime_type"))
    is_png, is_jpeg = F.col("mime_type") == "image/png", F.col("mime_type") == "image/jpeg"
    # frame headers come before the image data, mostly near the start, and behind at most some metadata segments of 64 KB
    sized = typed.withColumn("_near", jpeg_size(F.when(is_jpeg, F.substring(c, 1, NEAR))))
    sized = sized.withColumn("_jpeg", jpeg_size(F.when(is_jpeg & F.col("_near.width").isNull() & (F.col("size_bytes") > NEAR), F.substring(c, 1, HEAD))))

    def png(at: int) -> Column:
        return F.when(is_png & (F.col("size_bytes") >= 24), F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("int"))

    extra = [F.base64(c).alias("base64_data")] if with_content else []
    facts = sized.select(
        "path", "size_bytes", "mime_type", F.coalesce("_near.width", "_jpeg.width", png(17)).alias("width"),
        F.coalesce("_near.height", "_jpeg.height", png(21)).alias("height"), F.sha2(c, 256).alias("hash_sha256"), *extra)
    error = F.when(F.col("hash_sha256").isNotNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.when(F.col("length") > largest, F.concat(F.lit("larger than "), F.lit(largest), F.lit(" bytes")))
                .when(F.col("length") == 0, "empty").otherwise("cannot be read")))
    return listed.join(facts, "path", "left").select(
        "path", F.regexp_extract("path", r"[^/\\]+$", 0).alias("filename"), F.coalesce("size_bytes", F.lit(0).cast("long")).alias("size_bytes"),
        F.coalesce("mime_type", F.lit("unknown")).alias("mime_type"), "width", "height", "hash_sha256", *(["base64_data"] if with_content else []), error.alias("errors"))
