"""Fill-in-middle, byte-level BPE and collocations against brute force."""
import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from collectra.llm import bpe, collocations, middle
from collectra.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, h1 double, id string, ids int, row int"
ODD = [
    (1, "the cat sat on the mat"), (2, ""), (3, None), (None, "a b c"), (5, LONG), (5, LONG), (6, "a<P>b"), (7, "x<S"), (8, "\t \n\n  tail"), (None, None),
    (9, "É é ß word €😀 \x00 don't we'll"), (10, "<" * 50), (11, "abcdefgh" * 4000), (12, " " * 5000 + "x"), (13, "語。" * 3000), (14, "\n\n \n" * 2000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, markers and clashing column names."""
    return spark.createDataFrame([(i, t, 0.5, "x", 1, 2) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_middle(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("source", ["odd", "table"])
def test_middle(spark, odd, source, monkeypatch):
    monkeypatch.setattr(middle, "SLICE", 5_000)
    docs = odd if source == "odd" else table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = middle.restored(middle.fill_in_middle(docs)).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((expected_middle(*r) for r in rows), key=str)
    assert Counter(r.text for r in found) == Counter(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_middle_of_nothing(nothing):
    assert middle.restored(middle.fill_in_middle(nothing)).collect() == []


def test_middle_keeps_forms_apart(spark):
    docs = spark.createDataFrame([(i, "ab cd ef") for i in range(300)], "doc_id long, text string")
    forms = Counter(r.form for r in middle.fill_in_middle(docs, plain_from=100, spm_below=0).collect())
    assert forms == {"psm": 300}
    assert Counter(r.form for r in middle.fill_in_middle(docs, plain_from=0).collect()) == {"plain": 300}


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("brute", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_ids(docs, rows, tokenizer, **how):
    found = bpe.decode(bpe.encode(docs, **how)).collect()
    wanted = [(i, b"".join(t.to_bytes(4, "little") for t in tokenizer.encode_ordinary(text or "")), (text or "").encode()) for i, text in rows]
    assert sorted(((r.id, bytes(r.ids), bytes(r.bytes)) for r in found), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("size", [bpe.CHUNK, 4096, 64])
def test_bpe(odd, tokenizer, size):
    check_ids(odd, ODD, tokenizer, size=size)


def test_bpe_of_table(spark, tokenizer):
    docs = table(spark, SF, "documents")
    check_ids(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizer, size=1024)


def test_bpe_of_random_texts(spark, tokenizer):
    """White space runs, contractions and unlike scripts at every place of a chunk border."""
    rng = random.Random(13)
    bits = ["'ll", "'s", "'", "  ", "\n", " \n\n", "abc", "12", "é", "語", "😀", "!?", " x", "　", "\x1c", "​"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(20, 400)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_ids(docs, rows, tokenizer, size=40)


def test_bpe_of_nothing(nothing):
    assert bpe.decode(bpe.encode(nothing)).collect() == []


def test_middle_as_sql(spark):
    from compare import differences, duck
    assert differences(spark, duck(SF), SF, middle.op12, middle.OP12_SQL) is None


def expected_phrases(rows, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    frequent = {p: f for p, f in counts.items() if f >= least}
    longer = {}
    for (lang, p), f in frequent.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    longer[lang, p[i:j]] = max(longer.get((lang, p[i:j]), 0), f)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and 100 * longer.get((lang, p), 0) < 100 * a:
            cuts = [(1000 * a * totals[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), frequent[lang, p[:k]], frequent[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
                  for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows(seed=5, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Ä", "x'y", "new york", "a\tb", "über", " z"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "!?", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), ("fr", ""), ("en", "in the year of the cat " * 900), ("en", "a a a a a a")] * 2


def found_phrases(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a int, phrase string")
    return sorted(map(tuple, collocations.collocations(docs, **how).collect()))


@pytest.mark.parametrize("how", [
    {"least": 20}, {"least": 5, "block": 300}, {"least": 20, "top": 7}, {"least": 20, "longest": 2}])
def test_phrases(spark, how, monkeypatch):
    if "block" in how:  # many blocks, three levels of sums, keys beyond the dense part, texts in several parts
        monkeypatch.setattr(collocations, "FAN", 4)
        monkeypatch.setattr(collocations, "HEAD", 8)
        monkeypatch.setattr(collocations, "WINDOW", 100)
    rows = phrase_rows()
    wanted = expected_phrases(rows, how["least"], how.get("longest", 5), how.get("top", 2000))
    assert wanted and found_phrases(spark, rows, **how) == wanted


def test_no_phrases(spark):
    assert found_phrases(spark, []) == []
    assert found_phrases(spark, [("en", "one two"), (None, None)]) == []
    assert found_phrases(spark, [("en", "one. two. " * 200)]) == []


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, one, two = 3_000_000_000_000, 90_000_000_000_000, 4_000_000_000_000, 5_000_000_000_007
    row = spark.createDataFrame([(a, n, [one, a], [two, a])], "a long, n long, firsts array<long>, lasts array<long>")
    assert row.select(F.expr(collocations._LOWEST).alias("c")).select("c.score", "c.l", "c.r").first() == (1000 * a * n // (one * two), one, two)


def test_parts_of_a_long_text():
    text = (b"ab cd\xffef " * 9 + b"x" * 50 + b" y") * 3
    for size in (1, 7, 20, 1000):
        parts = list(collocations.portions(text, size))
        assert b"".join(parts) == text and all(p[-1:] in b" \xff" for p in parts[:-1])


def test_phrases_as_sql(spark):
    from compare import differences, duck
    assert differences(spark, duck(SF), SF, collocations.op11, collocations.OP11_SQL) is None
