"""CSV files with line breaks inside quotes, read by many tasks.

Spark cuts a file into blocks and hands out their lines. Whether a line begins a
record depends on the quotes before it, so each block is first reduced to what
it does to a reader that comes to it outside or inside a quoted cell. Composed in
file order, these functions tell how every block is entered; then each block puts
its own lines together, and only the pieces of records that cross a block's
border are gathered.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HEAD, MIDDLE, TAIL, WHOLE = 1, 2, 3, 4
EFFECTS = "file string, begin long, outside boolean, inside boolean, breaks boolean, broken boolean"
PIECES = "file string, begin long, kind int, first boolean, text string"


def plain_path(file: str) -> str:
    """A path as the listing and the reader's metadata both give it."""
    return re.sub(r"^file:/+", "/", file)


def lines_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, begin, value)``: the lines between line feeds, with the block they begin in."""
    lines = spark.read.option("lineSep", "\n").text(files)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Is the reader inside a quoted cell after this line? A quote opens a cell only as its
    first character; a doubled one stands for itself; what follows a closed cell up to the next
    delimiter is plain text."""
    at = 0
    while True:
        if inside:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line[at + 1:at + 2] != '"':
                    break
                at += 2
            inside = False
        elif line[at:at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(sep, at) + 1
        if not at:
            return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that lie in one block of one file."""
    if not batch.num_rows:
        return
    begin = batch.column("begin").to_numpy()
    file = pc.dictionary_encode(batch.column("file"))
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(begin) != 0) | (np.diff(code) != 0)) + 1
    for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield file.dictionary[code[at]].as_py(), int(begin[at]), batch.slice(at, end - at)


def block_effects(lines: DataFrame, seps: dict[str, str]) -> DataFrame:
    """Per block: is a reader inside quotes after it if it came to it outside, or inside;
    does any line end inside quotes or hold a lone carriage return; is any line not UTF-8. Blocks
    without row change nothing: only lines with a quote, such a return or bad bytes come to Python."""
    quote = F.col("value").contains('"')
    alone = F.col("value").rlike("\r(?!$)")
    bad = ~F.is_valid_utf8("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, begin, part in _runs(batch):
                state = known.setdefault((file, begin), [False, True, False, False])
                sep = seps[plain_path(unquote(file))]
                values = part.column("value").cast(pa.binary()).to_pylist()
                for raw, lone, broken in zip(values, part.column("lone").to_pylist(), part.column("bad").to_pylist(), strict=True):
                    line = raw.decode("latin-1")
                    state[0], state[1] = ends_inside(line, state[0], sep), ends_inside(line, state[1], sep)
                    state[2] |= state[0] or lone
                    state[3] |= broken
        rows = [(*key, *state) for key, state in known.items()]
        kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 4)
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in EFFECTS.split(", ")])

    marked = lines.where(quote | alone | bad).select("file", "begin", "value", alone.alias("lone"), bad.alias("bad"))
    return marked.mapInArrow(run, EFFECTS)


def entered_inside(effects: DataFrame) -> DataFrame:
    """``(file, begin)`` of the blocks that follow, in their file, a block left inside quotes, up to
    and with the one that ends it: how a block is left is what it makes of how it is
    entered, and that what the last block with one answer for both gave, turned
    over by every block since that turns both."""
    line = Window.partitionBy("file").orderBy("begin")
    fixed = F.col("outside") == F.col("inside")
    turns = F.sum(F.when(~fixed & F.col("outside"), 1).otherwise(0)).over(line)
    last = F.last(F.when(fixed, F.struct(F.col("outside").cast("int").alias("state"), F.col("turns"))), ignorenulls=True).over(line)
    left = effects.withColumn("turns", turns).withColumn("last", last)
    state = F.pmod(F.coalesce("last.state", F.lit(0)) + F.col("turns") - F.coalesce("last.turns", F.lit(0)), F.lit(2)) == 1
    until = F.lead("begin").over(line)
    return left.withColumn("left_inside", state).withColumn("until", until).where("left_inside").select("file", "begin", "until")


def _is_inside(intervals: dict[str, tuple[np.ndarray, np.ndarray]], file: str, begin: int) -> bool:
    """A block is entered inside quotes if it lies behind one that is left so, and not behind
    the next block that has quotes of its own."""
    if file not in intervals:
        return False
    after, until = intervals[file]
    i = int(np.searchsorted(after, begin)) - 1
    return i >= 0 and begin <= until[i]


class Assembler:
    """Puts the lines of one block together; ``inside`` tells how the block is entered."""

    def __init__(self, file: str, begin: int, inside: bool, sep: str, crlf: bool):
        self.file, self.begin, self.inside, self.sep, self.crlf = file, begin, inside, sep, crlf
        self.kind = HEAD if inside else WHOLE
        self.pending: list[pa.Array] = []
        self.header = begin == 0  # the first record of a file with any character

    def rows(self, texts: pa.Array, kind: int) -> Iterator[pa.RecordBatch]:
        if self.crlf:  # as when such a file is read whole, also inside quotes
            texts = pc.replace_substring_regex(texts, pattern=b"\r(\n|$)", replacement=rb"\1")
        if kind == WHOLE:
            texts = texts.filter(pc.greater(pc.binary_length(texts), 0))
        n = len(texts)
        if n:
            first = np.zeros(n, bool)
            if self.header and kind in (WHOLE, TAIL):
                first[0], self.header = True, False
            columns = [pa.array([self.file] * n), pa.array([self.begin] * n), pa.array([kind] * n, pa.int32()), pa.array(first), texts.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    def joined(self) -> pa.Array:
        lines = pa.concat_arrays(self.pending)
        self.pending = []
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")

    def take(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows of the records that end in these lines of the block."""
        inside = np.zeros(len(lines) + 1, bool)  # before each line, and behind the last
        inside[:] = self.inside
        for i in np.flatnonzero(pc.match_substring(lines, pattern=b'"').to_numpy(zero_copy_only=False)).tolist():
            left = ends_inside(lines[i].as_py().decode("latin-1"), bool(inside[i]), self.sep)
            if left != inside[i]:
                inside[i + 1:] = left
        self.inside = bool(inside[-1])
        begins = np.flatnonzero(~inside[:-1])
        first = int(begins[0]) if len(begins) else len(lines)
        if first:
            self.pending.append(lines.slice(0, first))
        if self.pending and (len(begins) or not self.inside):
            yield from self.rows(self.joined(), self.kind)
        if not len(begins):
            if not self.inside:
                self.kind = WHOLE
            return
        self.kind = WHOLE
        last = int(begins[-1]) if self.inside else len(lines)
        offsets = pa.array(np.append(begins[begins < last], last).astype(np.int32))
        if len(offsets) > 1:
            yield from self.rows(pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n"), WHOLE)
        if self.inside:
            self.pending = [lines.slice(last)]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.pending:
            yield from self.rows(self.joined(), MIDDLE if self.kind == HEAD else TAIL)


def assembled(lines: DataFrame, sep: str, crlf: dict[str, bool], intervals: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Records and pieces of records of every block. ``crlf`` names the files and tells whether their lines
    end with a carriage return, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for file, begin, part in _runs(batch):
                if block is None or (block.file, block.begin) != (file, begin):
                    if block:
                        yield from block.close()
                    block = Assembler(file, begin, _is_inside(intervals, file, begin), sep, crlf[plain_path(unquote(file))])
                yield from block.take(pa.concat_arrays([part.column("value")]).cast(pa.binary()))
        if block:
            yield from block.close()

    return lines.mapInArrow(run, PIECES.replace("text string", "text binary"))


def whole_records(pieces: DataFrame) -> DataFrame:
    """``(text)`` of all records but the first of each file. Those that cross a border are
    the pieces from one that is left open up to the next that closes it."""
    line = Window.partitionBy("file").orderBy("begin", "kind")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(line))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "kind", "text"))), lambda p: p["text"].cast("string")), "\n")
    crossing = parts.groupBy("file", "number").agg(F.max("first").alias("first"), text.alias("text"))
    done = pieces.where((F.col("kind") == WHOLE) & ~F.col("first")).select(F.col("text").cast("string").alias("text"))
    return done.union(crossing.where(~F.col("first")).select("text"))


def block_states(spark: SparkSession, seps: dict[str, str]) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], set[str], set[str]]:
    """For files with their delimiters: the stretches of blocks that are entered inside quotes, the files with
    breaks inside quotes, and those that are not UTF-8. The driver gets two numbers per
    block that is left inside quotes, fewer than it plans blocks to read."""
    effects = cut_lineage(block_effects(lines_of(spark, list(seps)), {plain_path(f): s for f, s in seps.items()}))
    per_file = effects.groupBy("file").agg(F.max("breaks").alias("breaks"), F.max("broken").alias("broken")).collect()
    open_ = entered_inside(effects).orderBy("file", "begin").collect() if any(r["breaks"] for r in per_file) else []
    found: dict[str, list[tuple[int, int]]] = {}
    for file, begin, until in open_:
        found.setdefault(file, []).append((begin, np.iinfo(np.int64).max if until is None else until))
    intervals = {f: tuple(np.array(c, np.int64) for c in zip(*pairs, strict=True)) for f, pairs in found.items()}
    named = {plain_path(unquote(r["file"])): r for r in per_file}
    return intervals, {f for f in seps if (r := named.get(plain_path(f))) and r["breaks"]}, {f for f in seps if (r := named.get(plain_path(f))) and r["broken"]}


def read_records(spark: SparkSession, files: dict[str, bool], sep: str, names: list[str], charset: str, intervals: dict) -> DataFrame:
    """The records of files (with whether their lines end with CRLF) that share header line, delimiter and a
    character set with ASCII's quotes and line feeds, as text columns."""
    pieces = assembled(lines_of(spark, list(files)), sep, {plain_path(f): crlf for f, crlf in files.items()}, intervals)
    if charset != "UTF-8":
        pieces = pieces.withColumn("text", F.encode(F.decode("text", charset), "UTF-8"))
    ticked = [n.replace("`", "``") for n in names]
    schema = ", ".join(f"`{n}` string" for n in ticked)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    return whole_records(pieces).select(F.from_csv("text", schema, options).alias("r")).select("r.*")
