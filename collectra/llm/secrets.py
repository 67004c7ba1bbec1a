"""Secret scans: patterns over a text and over every layer that decodes out of it."""
from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
TO_STANDARD = bytes.maketrans(b"-_", b"+/")
AROUND = 80
UNPACKED = 1 << 26

Found = tuple[str, int, int]


def scan(text: str) -> list[Found]:
    """The base spans of a text: leftmost, not overlapping within a kind. A match that
    is too short is dropped after it has used up its characters."""
    out, low = [], text.lower()
    if any(k in low for k in KEYS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _text_of(raw: bytes, room: int) -> str | None:
    """Decoded bytes as readable text, unpacking gzip and zlib; None if they are neither."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 6 and raw[0] == 0x78 and raw[1] in (0x01, 0x5E, 0x9C, 0xDA)):
        try:
            raw = zlib.decompressobj(47).decompress(raw, room)
        except zlib.error:
            return None
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _unwrapped(text: str, room: int) -> Iterator[tuple[int, int, str, list[tuple[int, int]] | None]]:
    """Each encoded stretch of a layer: where it lies, its decoded text, and the
    place of each decoded character (None: the stretch as a whole)."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            try:
                decoded = raw.decode("utf-8")
            except UnicodeDecodeError:
                decoded = raw.decode("latin-1")
            places, at = [], m.start()
            for c in decoded:
                width = 3 * (len(c.encode()) if len(decoded) < len(raw) else 1)
                places.append((at, at + width))
                at += width
            yield m.start(), m.end(), decoded, places if at == m.end() else None
    if "\\" in text:
        for m in ESCAPES.finditer(text):
            parts = list(ESCAPE.finditer(m[0]))
            codes = [int(p[1], 16) for p in parts]
            if all(c < 0x110000 for c in codes):
                decoded = "".join(map(chr, codes))
                if any(0xD800 <= c < 0xE000 for c in codes):
                    decoded = decoded.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
                places = [(m.start() + p.start(), m.start() + p.end()) for p in parts] if len(decoded) == len(parts) else None
                yield m.start(), m.end(), decoded, places
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=").encode().translate(TO_STANDARD)
        body = body[:len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + b"=" * (-len(body) % 4))
        except binascii.Error:
            continue
        decoded = _text_of(raw, room)
        if decoded is not None:
            plain = len(decoded) == len(raw)
            places = [(m.start() + 4 * i // 3, min(m.end(), m.start() + -(-4 * (i + 1) // 3))) for i in range(len(raw))] if plain else None
            yield m.start(), m.end(), decoded, places


def _together(text: str) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """The next layers of a text: its encoded stretches replaced, with what stands
    around them. Stretches of one kind that touch the same surroundings share a layer."""
    length = len(text)
    run: list[tuple[int, int, str, list | None]] = []

    def layer():
        begin, end = run[0][0], run[-1][1]
        low = max(0, begin - AROUND)
        while low and not text[low - 1].isspace():
            low -= 1
        high = end
        while high < length and not text[high].isspace():
            high += 1
        out, places, at = [], [], low
        for a, b, decoded, own in run:
            out += [text[at:a], decoded]
            places += [(i, i + 1) for i in range(at, a)]
            places += own if own is not None else [(a, b)] * len(decoded)
            at = b
        out.append(text[at:high])
        places += [(i, i + 1) for i in range(at, high)]
        return "".join(out), places

    for found in _unwrapped(text, UNPACKED):
        if run and not 0 <= found[0] - run[-1][1] <= AROUND:
            yield layer()
            run = []
        run.append(found)
    if run:
        yield layer()


def deep_scan(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, depth)``: the base spans at depth 0, then those of decoded
    layers, mapped to the characters of the text that hold them.

    Layers wait in a worklist; each is scanned and unwrapped in turn until none is
    left. A layer met before at the same place is not taken again, so the list ends. One
    compressed stretch is unpacked to at most ``UNPACKED`` bytes, a guard against
    bombs."""
    base = scan(text)
    spans = {s: 0 for s in base}
    if "%" not in text and "\\" not in text and not BASE64.search(text):
        return [(*s, 0) for s in base]
    seen: set[tuple[str, int]] = set()
    work: list[tuple[str, list[tuple[int, int]] | None, int]] = [(text, None, 0)]
    while work:
        layer, places, depth = work.pop()
        for inner, at in _together(layer):
            if places is not None:
                at = [(places[a][0], places[b - 1][1]) for a, b in at]
            key = (inner, at[0][0] if at else 0)
            if key in seen or not at:
                continue
            seen.add(key)
            for kind, a, b in scan(inner):
                spans.setdefault((kind, min(p[0] for p in at[a:b]), max(p[1] for p in at[a:b])), depth + 1)
            work.append((inner, at, depth + 1))
    return [(*s, d) for s, d in spans.items()]


SPANS = "array<struct<kind:string,start:long,end:long,depth:int>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of every row: ``struct(kind, start, end, depth)`` by start, then kind
    as listed in ``KINDS``, in code points, end exclusive. A null or empty text has none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in sorted(deep_scan(t), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"id long, spans {SPANS}")


def redact(text: str) -> str:
    """The text with every span, overlapping ones joined, replaced by ``[kind]``."""
    out, at, open_kind, stop = [], 0, "", 0
    for kind, a, b, _ in sorted(deep_scan(text), key=lambda s: (s[1], -s[2])):
        if open_kind and a < stop:
            stop = max(stop, b)
            continue
        if open_kind:
            out.append(f"[{open_kind}]")
            at = stop
        out.append(text[at:a])
        open_kind, stop = kind, b
    if open_kind:
        out.append(f"[{open_kind}]")
        at = stop
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced, and ``size_col``, where there is
    one, counting the new text. Null texts stay null."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t) if t else t for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new, strict=True)]
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
