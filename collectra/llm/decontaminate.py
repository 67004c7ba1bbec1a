"""Benchmark decontamination: template windows, then slot consistency."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, table, texts
from .substrings import window_hashes

WIDTH, LITERALS, SHARE = 8, 3, 0.5
CHUNK_TOKENS = 2_000_000
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset(
    "% mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz pound pounds gram grams ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years km/h mph m/s hz w kw kwh v a j cal kcal "
    "meter meters metre metres kilometer kilometers kilogram kilograms degree degrees °c °f usd eur gbp dollar dollars euro euros cent cents $ € £ percent".split())
EDGE = "\"'`.,;:!?()[]{}<>|*#&~^_=+-/\\$%“”‘’«»„…"
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)


class Words(dict):
    """Numbers white-space separated words; per number: hash, kind, whether it is capitalised,
    may be a unit, and ends a sentence. Starts anew after a fixed number of words."""

    LIMIT = 1_000_000

    def __init__(self):
        super().__init__()
        self.size, self.room = 0, 1 << 12
        self.hashes, self.flags = np.zeros(self.room, np.uint64), np.zeros((self.room, 4), np.uint8)

    def __missing__(self, word: bytes) -> int:
        if self.size == self.room:
            self.room *= 2
            self.hashes, self.flags = np.resize(self.hashes, self.room), np.resize(self.flags, (self.room, 4))
        text = word.decode()
        core = text.strip(EDGE)
        low = core.lower()
        kind = LITERAL
        if not core:
            kind = LITERAL if text in UNITS else NOTHING
            low = text
        elif low[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        self.hashes[self.size] = xxhash.xxh3_64_intdigest(low.encode())
        self.flags[self.size] = (kind, kind == LITERAL and core[:1].isupper(), low in UNITS, text.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":"))
        self[word] = self.size
        self.size += 1
        return self.size - 1


PLACEHOLDERS = np.array([0, *(xxhash.xxh3_64_intdigest(f"<{k}>".encode()) for k in ("number", "name", "unit"))], np.uint64)


def template(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The canonical tokens of a text: hashes with placeholders, hashes of what stands
    there, kinds, and word positions. Numbers, units after a number, and capitalised
    words that do not begin a sentence become placeholders; bare marks are dropped."""
    if words.size > Words.LIMIT:
        words.__init__()
        words.clear()
    split = text.split()
    numbers = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
    kind, capital, unit, stop = words.flags[numbers].T
    kind = kind.copy()
    begins = np.concatenate([[True], stop[:-1] > 0])[:len(split)]
    after_number = np.concatenate([[False], kind[:-1] == NUMBER])[:len(split)]
    kind[(kind == LITERAL) & (unit > 0) & after_number] = UNIT
    kind[(kind == LITERAL) & (capital > 0) & ~begins] = NAME
    at = np.flatnonzero((kind != NOTHING))
    values, kind = words.hashes[numbers[at]], kind[at]
    return np.where(kind == LITERAL, values, PLACEHOLDERS[kind % 4]), values, kind, at


def template_windows(tokens: np.ndarray, width: int) -> np.ndarray:
    return window_hashes(tokens, np.arange(max(len(tokens) - width + 1, 0)), width, 0)


class Index:
    """Template windows and windows of values of some benchmark items. An item shorter
    than a window is one window of its own length. Template windows with fewer than
    ``LITERALS`` literal tokens say too little and are left out; windows of values all
    count, so that verbatim text is found whatever it is made of."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        words, by_width = Words(), defaultdict(list)  # by width, and whether of values
        self.items = []
        for key, text in items:
            tokens, values, kinds, _ = template(text, words)
            if not len(tokens):
                continue
            w = min(width, len(tokens))
            hashes = template_windows(tokens, w)
            literal = np.convolve(kinds == LITERAL, np.ones(w, int), "valid") >= min(LITERALS, w)
            for at in np.flatnonzero(literal):
                by_width[w, False].append((hashes[at], len(self.items), at))
            by_width[w, True] += [(h, len(self.items), at) for at, h in enumerate(template_windows(values, w))]
            self.items.append((key, tokens, values, kinds))
        self.windows = {}
        for w, rows in by_width.items():
            rows.sort(key=lambda r: r[0])
            self.windows[w] = tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))

    def matches(self, text: bytes, words: Words, share: float) -> list[tuple[int, str, float, int, int]]:
        """``(item, kind, share, first word, words matched)`` of each item that leaks into the text."""
        tokens, values, kinds, place = template(text, words)
        lines: dict[int, set[int]] = defaultdict(set)
        for (w, raw), (hashes, item, offset) in self.windows.items():
            if len(tokens) < w:
                continue
            found, start = template_windows(values if raw else tokens, w), None
            if not raw:
                other, start = _as_first_words(tokens, values, kinds, w)
                found, start = np.concatenate([found, other]), np.concatenate([np.arange(len(found)), start])
            low = np.searchsorted(hashes, found)
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == found)
            for at in hit.tolist():
                k = int(low[at])
                while k < len(hashes) and hashes[k] == found[at]:
                    lines[int(item[k])].add((at if raw else int(start[at])) - int(offset[k]))
                    k += 1
        out = []
        for i, diagonals in lines.items():
            key, wanted, own, own_kinds = self.items[i]
            best = None
            for d in sorted(diagonals):
                got = _aligned(wanted, own, own_kinds, tokens, values, d)
                if best is None or got[0].sum() > best[0].sum():
                    best = (*got, d)
            matched, same, d = best
            for other in sorted(diagonals):  # a word more or less shifts the rest of a passage
                if 0 < abs(other - d) <= WIDTH:
                    more, more_same = _aligned(wanted, own, own_kinds, tokens, values, other)
                    matched, same = matched | more, same & more_same
            part = float(matched.mean())
            if part >= share:
                first = int(place[max(d, 0)])
                out.append((key, "template" if not same else "exact" if part == 1 else "partial", part, first, int(matched.sum())))
        return out


def _as_first_words(tokens: np.ndarray, values: np.ndarray, kinds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that begin with a name, read as an item's first word, which is literal
    there: hashes and places. What stands before a copy decides how the text reads it."""
    at = np.flatnonzero(kinds[:len(kinds) - width + 1] == NAME)
    if not len(at):
        return np.zeros(0, np.uint64), at
    held = np.lib.stride_tricks.sliding_window_view(tokens, width)[at]
    held[:, 0] = values[at]
    return window_hashes(held.ravel(), np.arange(0, held.size, width), width, 0), at


def _aligned(wanted, own, own_kinds, tokens, values, d: int) -> tuple[np.ndarray, bool]:
    """Which tokens of an item agree with a text on one diagonal, by template or by value, and whether all slots
    hold the item's own values. A slot counts only where its value goes one to one with
    the item's: 3, 5, 3 fits 4, 7, 4 but not 4, 7, 9."""
    matched = np.zeros(len(wanted), bool)
    a, b = max(d, 0), min(d + len(wanted), len(tokens))
    matched[a - d:b - d] = (wanted[a - d:b - d] == tokens[a:b]) | (own[a - d:b - d] == values[a:b])
    slots = np.flatnonzero(matched & (own_kinds != LITERAL))
    to, back, same = {}, {}, True
    for s in slots.tolist():
        mine, theirs = int(own[s]), int(values[s + d])
        if to.setdefault(mine, theirs) != theirs or back.setdefault(theirs, mine) != mine:
            matched[s] = False
        elif mine != theirs:
            same = False
    if len(slots) and matched[slots].sum() * 2 < len(slots):
        matched[:] = False
    return matched, same


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in chunks of about ``CHUNK_TOKENS`` words; each is small enough to
    go to every task, and one pass over the documents takes each."""
    items = benchmark.select(benchmark.item_id.cast("long").alias("key"), benchmark.text.cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, ceil(size / 6 / CHUNK_TOKENS))
    for c in range(chunks):
        yield [(r["key"], r["text"].encode()) for r in items.where(F.pmod(F.xxhash64("key", "text"), F.lit(chunks)) == c).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item_id, kind, share, first_word, n_matched)``: one row per row of ``docs`` and
    benchmark item of which it holds at least ``share``, in template form.

    ``kind`` is ``exact`` (all of it, with its values), ``partial``, or ``template`` (other
    numbers, names or units, put in consistently). Null and empty texts and items give
    no rows; repeated rows and items each give their own. The documents are never
    shuffled; the benchmark goes to the tasks in chunks of bounded size, and every chunk
    meets every document."""
    rows = texts(docs, id_col, text_col)
    context, out = rows.sparkSession.sparkContext, None
    for items in _chunks(benchmark):
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = Index(shared.value, width), Words()
            for batch in batches:
                found = [(key, *m) for key, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True)
                         for m in index.matches(text, words, share)]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "item_id", "kind", "share", "first_word", "n_matched"])

        part = rows.mapInArrow(run, "id long, item_id long, kind string, share double, first_word long, n_matched long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all columns."""
    at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext
    for items in _chunks(benchmark):
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = Index(shared.value, width), Words()
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t or b"", words, share) for t in blobs(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
