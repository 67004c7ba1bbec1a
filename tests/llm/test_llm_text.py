"""Scoring, substring dedup, quality, secrets and decontamination against brute force."""
import base64
import gzip
import hashlib
import math
import urllib.parse
import zlib
from collections import Counter

import pytest

from collectra.llm import decontaminate, quality, scoring, secrets, substrings
from collectra.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, score double, id string, words int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, "the cat sat on the mat with the hat and a bat for the rat by the vat at the flat of the gnat"), (2, ""), (3, None), (None, "a b c"),
        (5, LONG), (5, LONG), (6, LONG + " tail"), (7, "\t \n"), (None, None), (8, "x " * 60), (9, "É é ß\u00a0word"),
    ]
    return spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_base(rows):
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts[b"\n"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b"\n"]
        out.append((i, len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 5)))
    return sorted(out, key=str), n


@pytest.mark.parametrize("source", ["odd", "table"])
def test_scores(spark, odd, source):
    docs = odd if source == "odd" else table(spark, SF, "documents")
    found = scoring.lm_scores(docs).collect()
    wanted, n = expected_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r.id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found), key=str) == wanted
    assert {r.train_tokens for r in found} == {n}
    assert all(r.score < 0 for r in found)
    if source == "table":
        held = [r for r in found if r.held_out]
        assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_normalised():
    import numpy as np
    model = scoring.Model(40, np.full(40, 1 / 40))
    context = np.zeros((40, scoring.CONTEXT), int) + 3
    assert abs(np.exp(model.log_probabilities(context, np.arange(40))).sum() - 1) < 1e-4


def test_known_words_beyond_the_list_are_joined(spark, monkeypatch):
    monkeypatch.setattr(scoring, "KNOWN_WORDS", 50)
    docs = table(spark, SF, "documents")
    found = scoring.lm_scores(docs).collect()
    wanted, _ = expected_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r.id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found), key=str) == wanted


def test_scores_of_nothing(nothing):
    assert scoring.lm_scores(nothing).collect() == []


def test_short_texts_teach_words_and_ends(spark):
    """Two words a text: a third of the tokens are ends, and the model's mean P(end) comes within a fifth of that."""
    import numpy as np
    docs = spark.createDataFrame([(i, f"left{i % 5} right{i % 5}") for i in range(120_000)], "doc_id long, text string")
    rows = scoring.texts(docs)
    vocab = scoring.vocabulary(scoring.word_counts(rows))
    model = scoring.train(rows, vocab)
    codes = scoring.Codes(vocab)
    ids = [codes.outputs[codes.of([b"left%d" % k, b"right%d" % k])] for k in range(5)]
    context, target = np.concatenate([scoring.windows(i) for i in ids]), np.concatenate(ids)
    ends = np.exp(model.log_probabilities(context, np.zeros(len(context), int)))
    assert abs(ends.mean() - 1 / 3) < 1 / 15
    assert np.exp(model.log_probabilities(context, target))[target > 0].mean() > 0.4  # 0.6 at best: the first word is one of five


def test_model_has_its_full_size():
    assert scoring.WORDS >= 320 and scoring.ENDINGS >= 191 and scoring.WIDTH >= 24


def test_texts_are_cut_into_words_twice(spark, monkeypatch):
    """Once to count words and once to number them; training and scoring read the numbers."""
    docs, read = table(spark, SF, "documents"), []
    kind = type(docs)
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *more: read.append(df.columns) or run(df, *more))
    scoring.lm_scores(docs)
    assert len(read) == 5 and sum("text" in columns for columns in read) == 2


def test_words_and_numbers_are_those_of_python():
    import numpy as np
    import pyarrow as pa
    rows = ["", " \t", "The CAT\x0b\x0csat  x\r\n", " é É\u00a0ß\x1cq ", "y", "cat the the"]
    words, lengths = scoring.split(pa.array(rows))
    wanted = [t.encode().lower().split() for t in rows]
    assert lengths.tolist() == [len(w) for w in wanted] and words.to_pylist() == sum(wanted, [])
    sliced = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows)], ["id", "text"]).slice(2)
    assert scoring.split(sliced.column(1))[1].tolist() == [4, 2, 1, 3]
    vocab = scoring.Vocabulary(9, 4, {b"the": 5, b"cat": 2, b"y": 1}, {scoring.END: 0, b"the": 1}, {b"at": 3, b"x": 4}, np.full(5, 0.2), np.ones(5))
    codes = scoring.Codes(vocab)
    outputs = codes.outputs[codes.of([b"the", b"cat", b"sat", b"x", b"y", b"unknown"])]
    assert outputs.tolist() == [1, 3, 3, 4, 2, 2, 0]


def test_pieces_of_a_text_score_like_the_whole(spark, odd, monkeypatch):
    rows = scoring.texts(odd)
    counts = scoring.word_counts(rows)
    vocab = scoring.vocabulary(counts)
    model = scoring.train(rows, vocab)

    def scores():
        found = scoring.score(scoring.number(rows, vocab), counts, vocab, model)
        return sorted(((r.id, r.n_tokens, r.n_known, round(r.score, 2)) for r in found.collect()), key=str)

    whole = scores()
    monkeypatch.setattr(scoring, "PIECE_TOKENS", 7)
    monkeypatch.setattr(scoring, "PIECE_BYTES", 10)
    assert scores() == whole


def test_training_step_follows_the_plain_gradient():
    import numpy as np
    rng = np.random.default_rng(1)
    prior = rng.dirichlet(np.ones(30))
    model, plain = scoring.Model(30, prior), scoring.Model(30, prior)
    trainer = scoring.Trainer(model, prior, 5, 0.1)
    context, target = rng.integers(0, 30, (200, scoring.CONTEXT)), rng.integers(0, 30, 200)
    noise = np.minimum(np.searchsorted(np.cumsum(prior), np.random.default_rng(5).random(scoring.NOISE)), 29)
    trainer.step(context.astype(np.uint16), target.astype(np.uint16))
    gradients = [np.zeros(a.shape) for a in plain.arrays()]
    for c, t in zip(context, target, strict=True):
        h = (plain.inputs[c] * plain.places).sum(axis=0)
        for w, own in [(t, True), *((w, False) for w in noise)]:
            odds = h @ plain.outputs[w] + plain.bias[w] - math.log(prior[w] * scoring.NOISE)
            g = (1 / (1 + math.exp(-odds)) - own) / 200
            gradients[1][w] += g * h
            gradients[3][w] += g
            for k, word in enumerate(c):
                gradients[0][word] += g * plain.outputs[w] * plain.places[k]
                gradients[2][k] += g * plain.outputs[w] * plain.inputs[word]
    for start, found, g in zip(plain.arrays(), model.arrays(), gradients, strict=True):
        g = g * 200 ** 0.5
        assert np.allclose(found, start - 0.1 * g / np.sqrt(0.05 + g * g), atol=1e-4)


def test_large_scores_stay_normalised():
    import numpy as np
    model = scoring.Model(40, np.full(40, 1 / 40))
    model.outputs *= 2000
    found = model.log_probabilities(np.zeros((40, scoring.CONTEXT), int) + 3, np.arange(40))
    assert np.isfinite(found).all() and abs(np.exp(found).sum() - 1) < 1e-4


def brute_substrings(rows, width=20):
    order = lambda i: (i is None, i or 0)
    split, first = [(i, (t or "").encode().split()) for i, t in rows], {}
    for i, words in split:
        for j in range(len(words) - width + 1):
            key, at = tuple(words[j:j + width]), (order(i), j)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for j in range(len(words) - width + 1):
            if first[tuple(words[j:j + width])] < (order(i), j):
                gone[j:j + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("flush", [substrings.FLUSH, 500])
@pytest.mark.parametrize("source", ["odd", "table"])
def test_substrings(spark, odd, source, flush, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", flush)
    docs = odd if source == "odd" else table(spark, SF, "documents")
    found = substrings.dedup_substrings(docs).collect()
    wanted = brute_substrings([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r.id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in found), key=str) == wanted


def test_cover_aligns_every_pair():
    period, cover = substrings.PERIOD, substrings.COVER
    assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))


def test_substrings_of_nothing(nothing):
    assert substrings.dedup_substrings(nothing).collect() == []


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    found = [r for r in quality.op5(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert len(found) > 10 and sum(r.predicted == labels[r.doc_id] for r in found) >= 0.95 * len(found)


def test_quality_of_odd_rows(spark, odd, nothing):
    stats = quality.features(odd)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    scores = quality.scored(stats, quality.learn(stats, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in quality.scored(stats, quality.learn(stats, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.scored(stats, quality.learn(stats, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(quality.features(nothing), quality.learn(stats, labels)).collect() == []
    assert quality.keep_good(odd, quality.learn(stats, labels)).columns == odd.columns


def test_statistics_fit_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, len(quality.FEATURES)))
    model = quality.fit(spark.createDataFrame([(v.tolist(), i % 2) for i, v in enumerate(x)], "x array<double>, label int"), shrink=0.0, ridge=0.0)
    assert np.allclose(model.mean[1], x[1::2].mean(axis=0))
    assert np.allclose(np.linalg.inv(model.factor[0].T @ model.factor[0]), np.cov(x[::2].T, bias=True))


SECRETS = [
    ('x token = "abcdefghij" y', [("assign", 2, 21, 0)]),
    ("secret: token=abc password1234567", [("assign", 0, 17, 0)]),
    ("token = short AKIAABCDEFGHIJKL " + "0f" * 16, [("access", 14, 30, 0), ("hex", 31, 63, 0)]),
    ("p ü " + urllib.parse.quote('password: "hunter2hunter2"'), [("assign", 4, 35, 1)]),
    ("z " + base64.b64encode(gzip.compress(b"secret=aaaaaaaa11111", mtime=0)).decode() + " q", [("assign", 2, 46, 1)]),
    ("token = " + "".join(f"\\u{ord(c):04x}" for c in "abcdefgh1234"), [("assign", 0, 80, 1)]),
    (urllib.parse.quote(urllib.parse.quote('secret="qqqqqqqqqqqq"')), [("assign", 0, 28, 2)]),
    ("%zz \\u12 " + "A" * 50, []), ("", []),
]


@pytest.mark.parametrize("text,wanted", SECRETS)
def test_secret_layers(text, wanted):
    assert sorted(secrets.deep_scan(text)) == sorted(wanted)
    assert not secrets.deep_scan(secrets.redact(text))


def test_secrets_of_odd_rows(spark, odd, nothing):
    more = spark.createDataFrame([(20 + i, t, 0.1, "y", 2) for i, (t, _) in enumerate(SECRETS)], SCHEMA)
    found = {r.id: r.spans for r in secrets.secret_spans(more).collect()}
    for i, (_, wanted) in enumerate(SECRETS):
        assert sorted(tuple(s) for s in found[20 + i]) == sorted(wanted)
    assert secrets.secret_spans(odd).where("size(spans) > 0").count() == 0
    assert secrets.secret_spans(nothing).collect() == []
    assert secrets.redacted(odd.unionByName(more)).columns == odd.columns


ITEM = "If Tom has 3 apples and buys 5 more, how many apples does Tom have after 3 days in total?"


def test_leaks(spark, odd, nothing):
    items = spark.createDataFrame([(1, ITEM, "a"), (2, None, "b"), (3, "", "c"), (4, "quite short one", "d"), (4, "quite short one", "d")], "item_id long, text string, doc_id string")
    texts = [
        ("xx. " + ITEM + " yy", {(1, "exact")}), (ITEM.replace("Tom", "Anna").replace("3", "4").replace("5", "7"), {(1, "template")}),
        (ITEM[:60], {(1, "partial")}), ("so a quite short one it is", {(4, "exact")}), ("apples and pears in total", set()), (None, set()), ("", set()),
        ("If Tom has 3 apples and no pears at all, what about the cat and the dog on Sunday?", set()),
    ]
    docs = spark.createDataFrame([(i, t, 0.0, "x", 1) for i, (t, _) in enumerate(texts)], SCHEMA)
    found = decontaminate.leaks(docs, items).collect()
    for i, (_, wanted) in enumerate(texts):
        assert {(r.item_id, r.kind) for r in found if r.id == i} == wanted
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, w) in enumerate(texts) if not w}
    assert decontaminate.leaks(nothing, items).collect() == [] and decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(odd, items).count() == odd.count()


def test_inconsistent_slots_do_not_count():
    index, words = decontaminate.Index([(1, ITEM.encode())], 8), decontaminate.Words()
    loose = ITEM.replace("after 3", "after 9").replace("does Tom", "does Bob")
    (_, kind, share, _, _), = index.matches(loose.encode(), words, 0.5)
    assert share < 1 and kind == "partial"


def test_leaks_in_chunks(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = sorted(decontaminate.leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "CHUNK_TOKENS", 100)
    assert sorted(decontaminate.leaks(docs, items).collect()) == whole
    texts = {r.item_id: r.text for r in items.collect()}
    given = {r.doc_id: r.text for r in docs.collect()}
    planted = {(d, i) for d, t in given.items() for i, x in texts.items() if x and x in (t or "")}
    assert planted <= {(r.id, r.item_id) for r in whole}


@pytest.mark.parametrize("item,text,kind", [
    ("What is 345 * 678 ?", "so then: What is 345 * 678 ? it said", "exact"),
    ("WHERE DID ANNA BOB AND CARL GO IN 1999", "see WHERE DID ANNA BOB AND CARL GO IN 1999 now", "exact"),
    ("The Old Man And The Sea By Ernest Hemingway", "he read The Old Man And The Sea By Ernest Hemingway twice", "exact"),
    ("What color is the sky at noon", "A Title Line\nWhat color is the sky at noon", "exact"),
    ("What color is the sky at noon", "Q1) What color is the sky at noon", "exact"),
    ("What do 3 apples and 4 pears cost", "Q1) What do 5 apples and 7 pears cost", "template"),
])
def test_verbatim_copies_match(item, text, kind):
    index = decontaminate.Index([(1, item.encode())], 8)
    assert [m[1] for m in index.matches(text.encode(), decontaminate.Words(), 0.5)] == [kind]
