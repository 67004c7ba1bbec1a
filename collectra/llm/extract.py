"""Main text of HTML pages by two-pass block rules."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TAG = re.compile(r"""<!--|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*>?)""")
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea select option svg math iframe object audio video canvas title button".split())
#: Elements that hold furniture of the page.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name furniture, and those that name comments.
HINTS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar navbar navigation nav menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended widget toolbar pagination pager skip login search complementary contentinfo alert".split())
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus discussion guestbook".split())
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was with as be by at this are from or an not have has but they which you his her their were "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et en un une que qui dans pour pas au sur ne se ce il est par avec plus son elle nous vous "
    "el los las y que en un una por con no su para es al lo como más pero sus le ya o este sí porque esta".split())
LONG, SHORT, LINKED, STOPS = 140, 60, 0.4, 0.25
GOOD, BAD, OPEN = 1, 0, -1


class Block:
    """A run of text between block tags, and where it stands."""

    __slots__ = ("parts", "linked", "inside", "furniture", "heading")

    def __init__(self, inside: bool, furniture: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.inside, self.furniture, self.heading = inside, furniture, heading


def _hinted(attributes: str, words: frozenset) -> bool:
    return any(p.lower() in words for m in ATTRIBUTE.finditer(attributes) for p in PARTS.split(m[1]))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without comments, scripts, styles and the like."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open block elements: name, furniture, inside an article
    furniture = inside = heading = False
    links, at, current = 0, 0, None

    def put(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(inside, furniture, heading)
            out.append(current)
        text = html.unescape(text) if "&" in text else text
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    while True:
        m = TAG.search(page, at)
        if m is None:
            put(page[at:])
            return out
        put(page[at:m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}(?![A-Za-z0-9])[^>]*>?", re.I).search(page, at)
                at = len(page) if end is None else end.end()
            if current is not None:
                put(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            put(" ")
            continue
        if name not in BLOCKS:
            continue
        current, links = None, 0
        if name == "hr":
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            if stack and stack[-1][0] in ("p", *HEADINGS):
                stack.pop()  # these hold no blocks
            if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()
            off, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if name in ("article", "main"):
                within = True
                off = off or _hinted(attributes, COMMENTS)
            elif name in FURNITURE or (name == "header" and not within):
                off = True
            elif name not in ("html", "body") and attributes:
                off = off or _hinted(attributes, HINTS) or _hinted(attributes, COMMENTS)
            stack.append((name, off, within))
        furniture, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        heading = bool(stack) and stack[-1][0] in HEADINGS


def _first_pass(text: str, block: Block, articles: bool) -> tuple[int, str]:
    """Decide a block by its place, its link density, its length and its stop words, and
    name the rule. To stand in an article lowers what is asked of a block; to stand
    outside, on a page with articles, raises it."""
    if block.furniture:
        return BAD, "furniture"
    linked = block.linked / max(1, len(text))
    if linked > LINKED:
        return BAD, "links"
    if block.heading or len(text) < SHORT:
        return OPEN, "open"
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
    if block.inside:
        return (GOOD, "inside") if linked < 0.1 or stops >= STOPS else (OPEN, "open")
    if len(text) >= LONG:
        return (GOOD if stops >= STOPS or (linked < 0.1 and not articles) else BAD), "length"
    return (GOOD, "stop words") if stops >= STOPS and not articles else (OPEN, "open")


def _nearest(first: list[tuple[int, str]], without: str = "") -> list[int | None]:
    """Of each block, the last decided one before it."""
    out, last = [], None
    for i, (label, rule) in enumerate(first):
        out.append(last)
        if label != OPEN and rule != without:
            last = i
    return out


def _both(first: list[tuple[int, str]], without: str = "") -> list[tuple[int | None, int | None]]:
    """Of each block, the nearest decided ones before and after it."""
    after = [None if i is None else len(first) - 1 - i for i in _nearest(first[::-1], without)][::-1]
    return list(zip(_nearest(first, without), after, strict=True))


def labelled(page: str) -> list[tuple[str, int, str]]:
    """Text, label and deciding rule of each block of a page.

    First pass: furniture by element and class, then link density, length, share of stop
    words and place decide a block. Second pass: headings and short blocks that are still
    open take the label of the nearest decided block, and of two at the same distance the
    next. On a page with articles, an open block inside goes only if all decided blocks
    next to it that are not furniture go, and one outside stays only between two that
    stay. A page without any decided block keeps its open ones."""
    found = [(t, b) for b in blocks(page) if (t := " ".join("".join(b.parts).split()))]
    articles = any(b.inside and not b.furniture for _, b in found)
    first = [_first_pass(t, b, articles) for t, b in found]
    around, text = _both(first), _both(first, "furniture")
    final = []
    for i, (label, _) in enumerate(first):
        if label == OPEN:
            before, after = text[i] if found[i][1].inside else around[i]
            near = [first[j][0] for j in (before, after) if j is not None]
            if articles:
                label = GOOD if (found[i][1].inside and (GOOD in near or not near)) or near == [GOOD, GOOD] else BAD
            elif not near:
                label = GOOD
            else:
                label = first[after if after is not None and (before is None or after - i <= i - before) else before][0]
        final.append(label)
    return [(t, v, "neighbours" if rule == "open" else rule) for (t, _), v, (_, rule) in zip(found, final, first, strict=True)]


def main_text(page: str) -> str:
    """The article of a page: its blocks, white space joined, one per line."""
    return "\n".join(t for t, v, _ in labelled(page) if v == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every row; a null or empty page has an empty text.
    Each page is parsed once, in one pass that keeps no more than its own blocks."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
