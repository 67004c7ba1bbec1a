"""Phrase collocations: words numbered by frequency, pairs of numbers counted by address,
and frequent pairs numbered anew as the words of the next turn."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..operators.sampling import row_numbers
from ..session import cut_lineage
from .common import blobs, table

#: Pieces end at these characters, words at blanks and tabs.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
#: Between language and word; like BREAK, no byte of UTF-8.
BETWEEN = b"\xfe"
_FOLD = bytes(0xFF if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Numbers below HEAD are counted in one dense array of HEAD x HEAD cells; the others as sorted keys.
HEAD = 2048
#: Cells go to places by tiles of 16 x 16 numbers.
TILE = 4
BLOCK = 4_000_000
WINDOW = 8 << 20
#: What meets in one group: this many blocks, or sums of this many groups.
FAN = 512

NUMBERED = "block long, place long, data binary, counts binary, numbers binary, langs array<string>, sums array<long>"
UNITS = "block long, units binary"
CELLS = "part long, place long, keys binary, counts binary, numbers binary"
DECIDED = "part long, place long, keys binary, ids binary, counts binary"


def packed(values: np.ndarray) -> bytes:
    """Numbers, compressed: first all their first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


class Pairs:
    """Keys of pairs: two ids in 64 bits, in sorted arrays."""

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        return packed(np.diff(keys, prepend=np.uint64(0)))

    @staticmethod
    def unpack(blob: bytes) -> np.ndarray:
        return np.cumsum(unpacked(blob, "<u8"), dtype=np.uint64)

    @staticmethod
    def places(keys: np.ndarray, places: int) -> np.ndarray:
        """The place of each pair, by its tile."""
        tile = ((keys >> np.uint64(32 + TILE)) << np.uint64(32)) | ((keys & np.uint64(0xFFFFFFFF)) >> np.uint64(TILE))
        tile = (tile ^ (tile >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((tile ^ (tile >> np.uint64(29))) % np.uint64(places)).astype(np.int64)

    @staticmethod
    def sums(each: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(each), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)

    @staticmethod
    def held(own: np.ndarray, known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some keys are known, and their ids."""
        if not len(known):
            return np.zeros(len(own), bool), ids
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        return hit, ids[at[hit]]


class Words:
    """Keys of words: language and word in one, in sorted arrays of bytes objects."""

    @staticmethod
    def array(keys: list[bytes]) -> np.ndarray:
        out = np.empty(len(keys), object)
        out[:] = keys
        return out

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(BREAK.join(keys.tolist()))

    @staticmethod
    def unpack(blob: bytes) -> np.ndarray:
        return Words.array(zstandard.ZstdDecompressor().decompress(blob).split(BREAK))

    @staticmethod
    def places(keys: np.ndarray, places: int) -> np.ndarray:
        return np.fromiter(map(crc32, keys.tolist()), np.int64, len(keys)) % places

    @staticmethod
    def sums(each: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[bytes, int] = {}
        for keys, n in zip(each, times, strict=True):
            for key, value in zip(keys.tolist(), n.tolist(), strict=True):
                counts[key] = counts.get(key, 0) + value
        found = sorted(counts)
        return Words.array(found), np.array([counts[k] for k in found], np.int64)

    @staticmethod
    def held(own: np.ndarray, known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = dict(zip(known.tolist(), ids.tolist(), strict=True))
        found = [to.get(k, 0) for k in own.tolist()]
        hit = np.array(found, "<u4")
        return hit > 0, hit[hit > 0]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Numbers(dict):
    """Numbers of the words of one language in a block, in the order they come."""

    def __init__(self, counter: count):
        super().__init__({BREAK: 0})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        number = self[word] = next(self.counter)
        return number


def portions(text: bytes, size: int) -> Iterator[bytes]:
    """A folded text in parts of about ``size`` bytes, cut behind a break if a part has one, else
    behind a blank, else behind the word that is longer than a part."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(BREAK, at, at + size) + 1
        if end <= at:
            end = max(text.rfind(b, at, at + size) for b in (b" ", b"\t")) + 1
        if end <= at:
            end = min((i for i in (text.find(b, at + size) for b in (b" ", b"\t", BREAK)) if i >= 0), default=len(text) - 1) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def numbered_words(docs: DataFrame, places: int, block: int = BLOCK) -> DataFrame:
    """Blocks of about ``block`` words: one row with the words as numbers of that block (0: a
    break) and the sum of each language, and per place one with the words that belong there,
    how often they come, and their numbers."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))

    def rows(block_id: int, parts: list[np.ndarray], langs: dict[str, Numbers]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        times = np.bincount(tokens)
        own = [np.fromiter(words.values(), np.int64, len(words)) for words in langs.values()]
        sums = [int(times[n[n > 0]].sum()) for n in own]
        out = [(block_id, None, packed(tokens), None, None, list(langs), sums)]
        found = [(lang.encode() + BETWEEN + w, i) for lang, words in langs.items() for w, i in words.items() if i]
        if found:
            keys, numbers = zip(*sorted(found), strict=True)
            numbers = np.array(numbers, "<i4")
            out += [(*row, None, None) for row in _dealt(Words, block_id, Words.array(keys), times[numbers], places, numbers)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _names(NUMBERED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_id = TaskContext.get().partitionId() << 28
        parts, langs, counter, size = [], {}, count(1), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                for portion in portions(text.translate(_FOLD) + BREAK, WINDOW):
                    words = portion.replace(BREAK, b" \xff ").split()
                    number = langs.get(lang)
                    if number is None:
                        number = langs[lang] = Numbers(counter)
                    parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    if size >= block and words[-1] == BREAK:
                        yield rows(block_id, parts, langs)
                        parts, langs, counter, size, block_id = [], {}, count(1), 0, block_id + 1
        if size:
            yield rows(block_id, parts, langs)

    return cut_lineage(docs.mapInArrow(run, NUMBERED))


def squeezed(units: np.ndarray) -> bytes:
    """Units without repeated breaks."""
    return packed(units[(units > 0) | np.append(False, units[:-1] > 0)].astype("<u4"))


def first_units(tokens: DataFrame, decided: DataFrame) -> DataFrame:
    """Each block's words as ids by frequency; 0 is a break or a word that is not frequent."""

    def run(held: pa.Table, known: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _no_units()
        words = unpacked(held["data"][0].as_py(), "<i4")
        to = np.zeros(int(words.max(initial=0)) + 1, np.uint32)
        for numbers, ids in zip(known["keys"].to_pylist(), known["ids"].to_pylist(), strict=True):
            to[unpacked(numbers, "<i4")] = unpacked(ids, "<u4")
        return pa.table({"block": held["block"], "units": pa.array([squeezed(to[words])], pa.binary())})

    return cut_lineage(tokens.select("block", "data").groupBy("block").cogroup(_back(decided).groupBy("block")).applyInArrow(run, UNITS))


def _back(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("part").isNotNull()).select(F.col("part").alias("block"), "keys", "ids")


def _no_units() -> pa.Table:
    return pa.table({"block": pa.array([], pa.int64()), "units": pa.array([], pa.binary())})


def neighbours(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where two units touch, and both of them."""
    left, right = units[:-1], units[1:]
    both = (left > 0) & (right > 0)
    return both, left[both].astype(np.uint64), right[both].astype(np.uint64)


def counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of pairs and how often each comes."""
    head = (left < HEAD) & (right < HEAD)
    dense = np.bincount((left[head] * np.uint64(HEAD) + right[head]).astype(np.int64), minlength=HEAD * HEAD)
    cells = np.flatnonzero(dense)
    keys, times = np.unique((left[~head] << np.uint64(32)) | right[~head], return_counts=True)
    keys = np.concatenate([((cells // HEAD).astype(np.uint64) << np.uint64(32)) | (cells % HEAD).astype(np.uint64), keys])
    times = np.concatenate([dense[cells], times])
    order = np.argsort(keys, kind="stable")
    return keys[order], times[order]


def _dealt(kind: type, part: int, keys: np.ndarray, times: np.ndarray, places: int, numbers: np.ndarray | None = None) -> list[tuple]:
    """Rows of CELLS, one for each place."""
    place = kind.places(keys, places)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    return [
        (part, int(place[at[0]]), kind.pack(keys[at]), packed(times[at].astype("<i8")), None if numbers is None else packed(numbers[at]))
        for at in np.split(order, cuts) if len(at)
    ]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = _names(schema)
    kinds = [pa.int64() if c.endswith("long") else pa.binary() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def decide(kind: type, cells: DataFrame, parts: int, places: int, least: int, fan: int = FAN) -> DataFrame:
    """Keys that come ``least`` times or more, numbered by frequency within their place.

    Rows without ``part`` hold a place's frequent keys with ids and counts; rows with it go back
    to a part with the frequent keys that it has, or the part's own numbers of them. Of more than
    ``fan`` parts, groups of ``fan`` are summed first and dealt over 64 times the places; the answer
    comes back the same way."""

    def each_of(group: pa.Table) -> list[np.ndarray]:
        return [kind.unpack(b) for b in group["keys"].to_pylist()]

    def sums_of(group: pa.Table, each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return kind.sums(each, [unpacked(b, "<i8") for b in group["counts"].to_pylist()])

    def answers(group: pa.Table, each: list[np.ndarray], known: np.ndarray, ids: np.ndarray) -> list[tuple]:
        out = []
        for part, place, numbers, own in zip(group["part"].to_pylist(), group["place"].to_pylist(), group["numbers"].to_pylist(), each, strict=True):
            hit, found = kind.held(own, known, ids)
            if len(found):
                keys = kind.pack(own[hit]) if numbers is None else packed(unpacked(numbers, "<i4")[hit])
                out.append((part, place, keys, packed(found), None))
        return out

    if parts <= fan:

        def choose(group: pa.Table) -> pa.Table:
            place, each = group["place"][0].as_py(), each_of(group)
            keys, times = sums_of(group, each)
            keys, times = keys[times >= least], times[times >= least]
            ids = np.empty(len(keys), np.uint64)
            ids[np.argsort(-times, kind="stable")] = np.arange(len(keys), dtype=np.uint64) * np.uint64(places) + np.uint64(place + 1)
            if len(ids) and ids.max() >= 1 << 32:
                raise OverflowError("more than 4,294,967,295 frequent phrases of one length")
            ids = ids.astype("<u4")
            total = [(None, place, kind.pack(keys), packed(ids), packed(times))] if len(keys) else []
            return _table(total + answers(group, each, keys, ids), DECIDED)

        return cut_lineage(cells.groupBy("place").applyInArrow(choose, DECIDED))

    def merge(group: pa.Table) -> pa.Table:
        return _table(_dealt(kind, group["above"][0].as_py(), *sums_of(group, each_of(group)), 64 * places), CELLS)

    def hand_down(group: pa.Table, answer: pa.Table) -> pa.Table:
        if not answer.num_rows or not group.num_rows:
            return _table([], DECIDED)
        known, ids = np.concatenate(each_of(answer)), np.concatenate([unpacked(b, "<u4") for b in answer["ids"].to_pylist()])
        order = np.argsort(known, kind="stable")
        return _table(answers(group, each_of(group), known[order], ids[order]), DECIDED)

    fewer = ceil(parts / fan)
    cells = cut_lineage(cells.withColumn("above", F.pmod(F.xxhash64("part"), F.lit(fewer))))
    above = decide(kind, cells.groupBy("place", "above").applyInArrow(merge, CELLS), fewer, 64 * places, least, fan)
    answer = above.where(F.col("part").isNotNull()).select((F.col("place") % places).alias("place"), F.col("part").alias("above"), "keys", "ids")
    back = cells.groupBy("place", "above").cogroup(answer.groupBy("place", "above")).applyInArrow(hand_down, DECIDED)
    return cut_lineage(above.where(F.col("part").isNull()).unionByName(back))


def pairs(units: DataFrame, places: int) -> DataFrame:
    """Each block's pairs of touching units, counted, as rows of CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, left, right = neighbours(unpacked(blob, "<u4"))
                yield from _table(_dealt(Pairs, block, *counted(left, right), places), CELLS).to_batches()

    return units.mapInArrow(run, CELLS)


def next_units(units: DataFrame, decided: DataFrame) -> DataFrame:
    """Where a frequent pair begins, its id; elsewhere a break. The ids of HEAD x HEAD pairs are
    read by address."""

    def run(held: pa.Table, known: pa.Table) -> pa.Table:
        if not held.num_rows or not known.num_rows:
            return _no_units()
        keys = np.concatenate([Pairs.unpack(b) for b in known["keys"].to_pylist()])
        ids = np.concatenate([unpacked(b, "<u4") for b in known["ids"].to_pylist()])
        one, two = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        near = (one < HEAD) & (two < HEAD)
        dense = np.zeros((HEAD, HEAD), np.uint32)
        dense[one[near], two[near]] = ids[near]
        order = np.argsort(keys[~near])
        far, far_ids = keys[~near][order], ids[~near][order]
        units = unpacked(held["units"][0].as_py(), "<u4")
        both, left, right = neighbours(units)
        head = (left < HEAD) & (right < HEAD)
        found = np.zeros(len(left), np.uint32)
        found[head] = dense[left[head], right[head]]
        tail = (left[~head] << np.uint64(32)) | right[~head]
        if len(far):
            at = np.minimum(np.searchsorted(far, tail), len(far) - 1)
            found[~head] = np.where(far[at] == tail, far_ids[at], 0)
        out = np.zeros(len(units), np.uint32)
        out[:-1][both] = found
        return pa.table({"block": held["block"], "units": pa.array([squeezed(out)], pa.binary())})

    return cut_lineage(units.groupBy("block").cogroup(_back(decided).groupBy("block")).applyInArrow(run, UNITS))


def frequent_words(decided: DataFrame) -> DataFrame:
    """``(id, lang, word, a)`` from the rows of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                langs, words = zip(*([p.decode("utf-8", "replace") for p in k.split(BETWEEN, 1)] for k in Words.unpack(keys)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpacked(ids, "<u4").astype(np.int64)), pa.array(langs), pa.array(words), pa.array(unpacked(times, "<i8"))], ["id", "lang", "word", "a"])

    return decided.where(F.col("part").isNull()).select("keys", "ids", "counts").mapInArrow(run, "id long, lang string, word string, a long")


def frequent_pairs(decided: DataFrame) -> DataFrame:
    """``(id, left, right, a)`` from the rows of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = Pairs.unpack(keys)
                columns = (unpacked(ids, "<u4"), keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), unpacked(times, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "left", "right", "a"])

    return decided.where(F.col("part").isNull()).select("keys", "ids", "counts").mapInArrow(run, "id long, left long, right long, a long")


#: The lowest of the scores of all cuts, with its parts; of equal ones the first.
_LOWEST = """array_min(transform(sequence(1, size(firsts) - 1), k -> named_struct(
  'score', (cast(a AS decimal(20, 0)) * 1000) * cast(n AS decimal(18, 0)) div (cast(firsts[k - 1] AS decimal(19, 0)) * cast(lasts[size(firsts) - k - 1] AS decimal(19, 0))),
  'k', k, 'l', firsts[k - 1], 'r', lasts[size(firsts) - k - 1])))"""


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100, block: int = BLOCK,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two to
    ``longest`` words that come ``least`` times or more.

    A phrase is as strong as its weakest cut: floor(1000 a n / (l r)), where l and r count the
    words before and behind the cut. One that lies in a longer candidate with at least ``inside``
    percent of its count is dropped; a candidate of one word more is enough to tell, as every
    longer one contains such a one that is no rarer.

    Texts become blocks of word numbers, once. What a block counts goes to places, which sum it,
    number what is frequent by frequency, and tell each block the ids of what it has: first of
    its words, then in each turn of its pairs of neighbours, which are counted by address for low
    ids and as sorted keys for the others, and go to places by tiles. Two frequent pairs that
    overlap are the pairs of the next turn. A block sends each word and pair once, so none
    is more than one cell per block, and no group holds more than ``FAN`` blocks' cells of a place.

    Of equal cuts the first counts, and equal scores go by count, then by the phrase's bytes. Null
    texts are empty; a null language counts as ``und``; repeated rows count each; no rows, or
    no frequent phrase, give no rows. Further columns are not read. A text of any length
    is read in parts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    places = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
    numbered = numbered_words(rows, places, block)
    tokens = numbered.where(F.col("place").isNull())
    blocks = tokens.count()
    known = decide(Words, numbered.where(F.col("place").isNotNull()).select(F.col("block").alias("part"), "place", F.col("data").alias("keys"), "counts", "numbers"), blocks, places, least)
    totals = tokens.select(F.explode(F.arrays_zip("langs", "sums")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.sums").alias("n"))
    level = cut_lineage(lookup_join(frequent_words(known), totals, "lang", "inner").select(
        "id", "lang", F.col("word").alias("phrase"), "a", F.array("a").alias("firsts"), F.array("a").alias("lasts"), "n"))
    units = first_units(tokens, known)

    found: list[DataFrame] = []
    for words_in in range(2, longest + 1):
        decided = decide(Pairs, pairs(units, places), blocks, places, least)
        both = frequent_pairs(decided)
        if found:  # what lies in a phrase of one word more
            holders = both.select(F.col("left").alias("id"), F.col("a").alias("around")).union(both.select("right", "a")).groupBy("id").agg(F.max("around").alias("around"))
            found[-1] = level.join(holders, "id", "left").where(F.coalesce(F.col("around") * 100 < F.col("a") * inside, F.lit(True))).drop("around")
        before = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "firsts", "n")
        behind = level.select(F.col("id").alias("right"), F.col("phrase").alias("tail"), "lasts")
        level = cut_lineage(lookup_join(lookup_join(both, before, "left", "inner"), behind, "right", "inner").select(
            "id", "lang", F.concat_ws(" ", "head", F.substring_index("tail", " ", -1)).alias("phrase"), "a",
            F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts"), "n"))
        found.append(level)
        if level.isEmpty():
            break
        if words_in < longest:
            units = next_units(units, decided)
    scored = reduce(DataFrame.unionByName, found).withColumn("cut", F.expr(_LOWEST))
    ordered = row_numbers(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase"), name="at")
    begins = ordered.groupBy("lang").agg(F.min("at").alias("begin"))
    ranked = lookup_join(ordered, begins, "lang", "inner").withColumn("rank", F.col("at") - F.col("begin") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "".join(map(chr, range(65, 91)))
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, concat_ws(' ', {', '.join(f'w{i}' for i in range(k))}) AS phrase FROM grams WHERE w{k - 1} IS NOT NULL" for k in range(1, 6))
#: The same rows in DuckDB.
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
pieces AS (SELECT lang, d, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM d),
lists AS (SELECT lang, d, i, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, d, i, unnest(ws) AS w0, generate_subscripts(ws, 1) AS j FROM lists),
grams AS (SELECT lang, w0, lead(w0, 1) OVER line AS w1, lead(w0, 2) OVER line AS w2, lead(w0, 3) OVER line AS w3, lead(w0, 4) OVER line AS w4 FROM words WINDOW line AS (PARTITION BY d, i ORDER BY j)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, k, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (SELECT f.lang, f.k, f.phrase, f.f AS a, unnest(generate_series(1, f.k - 1)) AS c FROM f WHERE f.k > 1),
parts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS one, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS two FROM cuts),
scores AS (SELECT p.lang, p.k, p.phrase, p.a, p.c, x.f AS l, y.f AS r, n, (1000 * cast(p.a AS HUGEINT) * n) // (cast(x.f AS HUGEINT) * y.f) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.one JOIN f y ON y.lang = p.lang AND y.phrase = p.two JOIN totals t ON t.lang = p.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = s.lang AND g.k > s.k AND 100 * g.f >= 100 * s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


def op11(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
