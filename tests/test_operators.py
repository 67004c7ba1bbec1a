"""Operators against brute force: joins under skew, ordered corrections, samples, exports."""
import hashlib
import random
import re
from collections import Counter
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from collectra.operators import authority, checks, dictionary, entities, joins, profile, remediation, sampling, similarity, terms
from collectra.sinks import common, enriched_csv, import_xml, jsonld, mets
from collectra.operators.standard import MAPPING


def test_lookup_join_paths_agree(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i % 40}", i) for i in range(600)] + [(None, -1)]
    big = spark.createDataFrame(rows, "k string, v int")
    small = spark.createDataFrame([("hot", "H"), ("hot", "I"), ("k3", "a"), ("k6", "b")], "k string, name string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, big.join(small, "k", how).collect()))
        with monkeypatch.context() as m:
            m.setattr(joins, "fits_broadcast", lambda df, *a, **k: False)
            assert sorted(map(str, joins.lookup_join(big, small, "k", how).collect())) == plain
        assert sorted(map(str, joins.lookup_join(big, small, "k", how).collect())) == plain
    assert not joins.fits_broadcast(big, max_rows=10) and joins.fits_broadcast(small)


def test_chained_lookups_read_the_large_side_once(spark, monkeypatch):
    """Large lookups on even keys, one after the other: the plan does not multiply, and none of them is broadcast."""
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, *a, **k: False)
    out = spark.range(3000).select(F.col("id").alias("k"))
    for i in range(4):
        out = joins.lookup_join(out, spark.range(0, 3000, i + 2).select(F.col("id").alias("k"), F.lit(i).alias(f"v{i}")), "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Range (0, 3000"), plan.count("BroadcastHashJoin")) == (1, 0)
    assert out.count() == 3000 and out.where("v0 = 0 AND v1 = 1 AND v2 = 2 AND v3 = 3").count() == 50


def test_ordered_text_keeps_everything(spark):
    rows = [("r1", "b", 2), ("r1", "a", 3), ("r1", "b", 9)] + [("big", f"v{i:03d}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, v string, o int")
    joined = {r["k"]: r["t"] for r in joins.ordered_text(df, ["k"], "v", "o", "t", "; ").collect()}
    assert joined == {"r1": "b; a", "big": "; ".join(f"v{i:03d}" for i in range(30))}


def fold(rows, suggestions):
    """One correction after the other, as a person would."""
    rows, log = [dict(r) for r in rows], []
    for s in suggestions:
        if s["status"] != "accepted" or s["action_type"] == "split_multi_value":
            continue
        col, old, new = s["target_field"], s["original_value"], s["suggested_value"]
        if s["action_type"] in remediation.LOGGED_ONLY:
            log.append((s["suggestion_id"], 0))
            continue
        if s["action_type"] == "move_value_to_field" and col not in rows[0]:
            for r in rows:
                r[col] = ""
        if col not in rows[0]:
            continue
        hit = [r for r in rows if r["record_id"] == s["item_id"]]
        if s["action_type"] == "normalize_label":
            hit = [r for r in rows if r[col] == old] if old is not None and new is not None else []
        elif s["action_type"] == "apply_suggested_value" and not hit:
            hit = [r for r in rows if old is not None and r[col] == old]
        elif s["action_type"] == "move_value_to_field":
            new = new or old
        for r in hit:
            r[col] = new
        if hit:
            log.append((s["suggestion_id"], len(hit)))
    return rows, log


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_corrections_match_fold(spark, seed):
    rnd = random.Random(seed)
    values = list("abcde")
    rows = [{"record_id": f"r{i % 25}", "x": rnd.choice(values), "y": rnd.choice(values + [None])} for i in range(40)]
    actions = ["apply_suggested_value", "apply_suggested_value", "normalize_label", "normalize_label", "move_value_to_field",
               "flag_for_authority_lookup", "split_multi_value"]
    sugs = []
    for i in range(40):
        action = rnd.choice(actions)
        target = rnd.choice(["x", "y", "z"]) if action == "move_value_to_field" else rnd.choice(["x", "y", "nope"])
        sugs.append({
            "suggestion_id": f"s{i}", "seq": i, "action_type": action, "original_value": rnd.choice(values + [None]), "suggested_value": rnd.choice(values),
            "item_id": rnd.choice([f"r{rnd.randrange(30)}", "missing"]), "target_field": target, "status": rnd.choice(["accepted"] * 4 + ["pending"]),
        })
    want, want_log = fold(rows, sugs)
    df = spark.createDataFrame(rows, "record_id string, x string, y string")
    sf = spark.createDataFrame(sugs, "suggestion_id string, seq long, action_type string, original_value string, suggested_value string, item_id string, target_field string, status string")
    out, log = remediation.apply_suggestions(df, sf)
    names = sorted({k for r in want for k in r})
    assert sorted(out.columns) == names
    key = lambda r: tuple(str(r[n]) for n in names)
    assert sorted(map(key, out.collect())) == sorted(map(key, want))
    assert sorted((r["suggestion_id"], r["n_cells"]) for r in log.collect()) == sorted(want_log)


def test_corrections_chain(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "c")], "record_id string, x string")
    rules = [("s1", 1, "normalize_label", "a", "b", None), ("s2", 2, "normalize_label", "b", "c", None), ("s3", 3, "apply_suggested_value", None, "z", "2"), ("s4", 4, "normalize_label", "a", "q", None)]
    sf = spark.createDataFrame([(*r, "x", "accepted") for r in rules], "suggestion_id string, seq long, action_type string, original_value string, suggested_value string, item_id string, target_field string, status string")
    out, log = remediation.apply_suggestions(df, sf)
    assert sorted((r[0], r[1]) for r in out.collect()) == [("1", "c"), ("2", "z"), ("3", "c")]
    logged = {r["suggestion_id"]: (r["n_cells"], r["original_value"]) for r in log.collect()}
    assert logged == {"s1": (2, "a"), "s2": (2, "b"), "s3": (1, "c")}


def test_checks_of_long_values(spark, monkeypatch):
    """The findings are the same whether values are kept or told by their hash."""
    rng = random.Random(3)
    parts = ["Kirche", "kirche", "Haus am See", "haus am see", "Ã¤pfel", " rand", "a, b", "x"]
    rows = [(f"r{i % 40}", *("; ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) if rng.random() > 0.2 else None for _ in range(2))) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id string, a string, b string")

    def everything():
        ds = profile.Dataset("d", df, "record_id")
        found, profiled = checks.analyze([ds])
        samples = profile.sample_values(df)
        return [sorted(map(str, x.collect())) for x in (found, profiled, samples)]

    wanted = everything()
    for short in (0, 1, 8, 20):
        monkeypatch.setattr(profile, "SHORT", short)
        monkeypatch.setattr(checks, "SHORT", short)
        assert everything() == wanted
        assert profile.value_counts(df).where(F.length("value") > short).isEmpty()
    assert any("term_variants" in f for f in wanted[0]) and any("encoding_issues" in f for f in wanted[0])


def brute_similar(left, right, threshold):
    sets = [{w: frozenset(w) for w in side if w} for side in (left, right)]
    return sorted((a, b, round(len(x & y) / len(x | y), 6)) for a, x in sets[0].items() for b, y in sets[1].items() if len(x & y) / len(x | y) >= threshold - 1e-9)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.75, 0.8, 1.0])
def test_similar_sets(spark, threshold):
    """Against all pairs; one word is in a third of all names."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]

    def side(n):
        out = [tuple(sorted(set(rng.choices(words, k=rng.randint(0, 7)) + (["hot"] if rng.random() < 0.35 else [])))) for _ in range(n)]
        return out + out[:20]

    left, right = side(120), side(150)
    frames = [spark.createDataFrame([(list(w),) for w in s], "words array<string>") for s in (left, right)]
    found = sorted((tuple(r["left_words"]), tuple(r["right_words"]), round(r["score"], 6)) for r in similarity.similar_sets(*frames, threshold).collect())
    assert found == brute_similar(set(left), set(right), threshold)


def test_similar_terms_of_nothing(spark):
    authority_schema = "authority_id string, preferred_name string, variants array<string>, authority_type string, source string, ord long"
    terms = spark.createDataFrame([("Haus am See", "LOC"), (None, "LOC"), ("  ", "LOC"), ("…", None), ("See-Haus (am)", "PER")], "text string, entity_type string")
    none = spark.createDataFrame([], authority_schema)
    assert similarity.similar_terms(terms, none).collect() == []
    some = spark.createDataFrame([
        ("a1", "Am See: Haus", ["Haus am Berg", "Seehaus"], "PlaceOrGeographicName", "gnd", 1), ("a2", "Haus", None, None, "gnd", 2),
        ("a3", "haus AM see", [], "PlaceOrGeographicName", "gnd", 3), ("a4", "", None, "Person", "gnd", 4)], authority_schema)
    got = {(r["text"], r["authority_id"]): (r["rank"], r["score"]) for r in similarity.similar_terms(terms, some, 0.5, 5).collect()}
    assert got == {("Haus am See", "a1"): (1, 1.0), ("Haus am See", "a3"): (2, 1.0)}
    free = {(r["text"], r["authority_id"]) for r in similarity.similar_terms(terms, some, 0.3, 5, by_type=False).collect()}
    assert free == {(t, a) for t in ("Haus am See", "See-Haus (am)") for a in ("a1", "a2", "a3")}


@pytest.mark.parametrize("automaton", [True, False])
def test_long_lists_of_substrings(spark, monkeypatch, automaton):
    """Terms inside terms, overlaps and several chunks, against a search of every term in every cell."""
    if automaton:
        monkeypatch.setattr(terms, "CHUNK_BYTES", 5_000)
    else:
        monkeypatch.setattr(terms, "ahocorasick", None)
    rng = random.Random(9)
    keys = sorted({"".join(rng.choice("abÄ .") for _ in range(rng.randint(1, 6))).strip() for _ in range(400)} - {""})
    texts = ["".join(rng.choice("abÄä .x") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "ab" * 5000]
    cells = spark.createDataFrame([(str(i), "c", t) for i, t in enumerate(texts)], "record_id string, column string, value string")
    listed = spark.createDataFrame([(k, "r", "c", "n", i) for i, k in enumerate(keys)], "term string, replacement string, category string, note string, ord int")
    found = {(r["record_id"], r["term"].lower()) for r in terms.scan_terms(cells, listed, whole_word=False, inline=0).collect()}
    assert found == {(str(i), k.lower()) for i, t in enumerate(texts) if t for k in keys if k.lower() in t.lower()}
    assert terms.scan_terms(cells, listed.limit(0), whole_word=False, inline=0).collect() == []


@pytest.mark.parametrize("automaton", [True, False])
def test_long_lists_of_words(spark, monkeypatch, automaton):
    """Words and phrases at all kinds of edges, by automaton and by token, against the pattern itself."""
    if not automaton:
        monkeypatch.setattr(terms, "ahocorasick", None)
    rng = random.Random(11)
    keys = sorted({"".join(rng.choice("abÄ. -") for _ in range(rng.randint(1, 5))).strip() for _ in range(300)} - {""})
    texts = ["".join(rng.choice("abÄä .,;x-(\u2003\xa0\x1c\"'") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "a"]
    cells = spark.createDataFrame([(str(i), "c", t) for i, t in enumerate(texts)], "record_id string, column string, value string")
    listed = spark.createDataFrame([(k, "r", "c", "n", i) for i, k in enumerate(keys)], "term string, replacement string, category string, note string, ord int")
    found = sorted((r["record_id"], r["term"].lower()) for r in terms.scan_terms(cells, listed, inline=0).collect())
    edge = "[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000,;.!?\"'()\\[\\]]"
    assert found == sorted({(str(i), k.lower()) for i, t in enumerate(texts) if t and t.strip() for k in keys
                            if re.search(f"(?:^|(?<={edge})){re.escape(k.lower())}(?={edge}|$(?!\\n))", t.lower())})


def test_many_terms_in_one_long_cell(spark):
    """A cell comes back once, not once for every term in it: 2,200 copies of a megabyte fit no batch."""
    keys = [f"k{i:04d}" for i in range(2200)]
    text = (" ".join(keys) + " ").ljust(1 << 20, "x")
    cells = spark.createDataFrame([("1", "c", text)], "record_id string, column string, value string")
    listed = spark.createDataFrame([(k, "", "", "", i) for i, k in enumerate(keys)], "term string, replacement string, category string, note string, ord int")
    for whole in (False, True):
        found = terms.scan_terms(cells, listed, whole_word=whole, inline=0).select("record_id", "term")
        assert sorted(r["term"] for r in found.collect()) == keys


SUGGESTED = "suggestion_id string, seq long, action_type string, original_value string, suggested_value string, item_id string, target_field string, status string"


def test_corrections_with_clashing_columns(spark):
    df = spark.createDataFrame([("r1", "r2", "k", "a"), ("r2", "r1", "k", "b")], "record_id string, item_id string, row_key string, subject string")
    df = df.withColumns({"_set": F.lit(1), "row_key_set": F.lit(2), "_new": F.lit("n"), "_hit": F.lit("h")})
    fix = spark.createDataFrame([("s1", 1, "apply_suggested_value", None, "new", "r1", "subject", "accepted"), ("s2", 2, "normalize_label", "n", "m", None, "_new", "accepted")], SUGGESTED)
    for id_column in (None, "record_id"):
        out, log = remediation.apply_suggestions(df, fix, id_column)
        assert out.columns == df.columns
        assert sorted(tuple(r) for r in out.collect()) == [("r1", "r2", "k", "new", 1, 2, "m", "h"), ("r2", "r1", "k", "b", 1, 2, "m", "h")]
        assert {r["suggestion_id"]: (r["n_cells"], r["original_value"]) for r in log.collect()} == {"s1": (1, "a"), "s2": (2, "n")}


@pytest.mark.parametrize("seed", range(3))
def test_corrections_by_any_id_column(spark, seed):
    """Each record is looked for in the id columns in turn; a row can be led to by several of them."""
    rng = random.Random(seed)
    names = ["p", "q", "r", "s", "t", None]
    rows = [(rng.choice(names[:3]), rng.choice([*names, "u"]), rng.choice("abc"), rng.choice("abc")) for _ in range(14)]
    fixes = []
    for i in range(16):
        kind = rng.choice(["apply_suggested_value", "apply_suggested_value", "normalize_label", "move_value_to_field"])
        fixes.append((f"s{i}", i + 1, kind, rng.choice("abcd"), rng.choice("abcd"), rng.choice([*names, "u", "v"]), rng.choice(["x", "y"]), "accepted"))
    table = [dict(zip(("record_id", "id", "x", "y"), r, strict=True)) for r in rows]
    log = {}
    for name, _, kind, old, new, item, column, _ in fixes:
        hit = next((found for c in ("record_id", "id") if item is not None and (found := [t for t in table if t[c] == item])), [])
        if kind == "normalize_label" or (kind == "apply_suggested_value" and not hit):
            hit = [t for t in table if t[column] == old]
        if hit:
            log[name] = len(hit)
            for t in hit:
                t[column] = new
    out, changes = remediation.apply_suggestions(spark.createDataFrame(rows, "record_id string, id string, x string, y string"), spark.createDataFrame(fixes, SUGGESTED))
    assert sorted(map(tuple, out.collect()), key=str) == sorted((tuple(t.values()) for t in table), key=str)
    assert {r["suggestion_id"]: r["n_cells"] for r in changes.collect()} == log


def test_samples(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"))
    a, b = sampling.sample_rows(df, "id", 137), sampling.sample_rows(df.repartition(5), "id", 137)
    assert a.count() == 137 and {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}
    parts = {r["g"]: r["count"] for r in sampling.sample_stratified(df, "id", "g", 0.1).groupBy("g").count().collect()}
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert parts == {g: max(1, round(n * 0.1)) for g, n in sizes.items()}
    chunks = sampling.chunk_numbers(df, "id", 128)
    assert chunks.where(F.col("chunk") != F.floor(F.col("id") / 128) + 1).count() == 0


def test_samples_are_refined_at_the_border(spark, monkeypatch):
    """One id in a third of all rows, some of them equal in every column, and no bucket above a few rows."""
    monkeypatch.setattr(sampling, "BORDER", 4)
    rows = [(7 if i % 3 == 0 else i, "same" if i % 6 == 0 else f"v{i}", {"k": i} if i % 6 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v string, m map<string,int>").withColumn("_key", F.lit(1))
    place = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i, *_ in rows}
    for n, digits in ((1, 1), (233, 1), (233, 3), (1000, 3)):
        got = [r["id"] for r in sampling.sample_rows(df, "id", n, digits=digits).collect()]
        assert sorted(got, key=place.get) == sorted((i for i, *_ in rows), key=place.get)[:n]
    # around the frequent id the border runs through its rows
    ordered = sorted((i for i, *_ in rows), key=place.get)
    n = ordered.index(7) + 120
    taken = sampling.sample_rows(df, "id", n, digits=1).collect()
    assert len(taken) == n and sum(r["id"] == 7 for r in taken) == 120
    whole = Counter((i, v, str(m)) for i, v, m in rows)
    assert all(k <= whole[r] for r, k in Counter((r["id"], r["v"], str(r["m"])) for r in taken).items())


def test_samples_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, g string")
    assert sampling.sample_rows(empty, "id", 5).collect() == []
    assert sampling.sample_stratified(empty, "id", "g", 0.5).collect() == []
    assert sampling.chunk_numbers(empty, "id", 5).collect() == []


def test_row_numbers_with_ties(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("_part"))
    got = {r["_part"]: r["n"] for r in sampling.row_numbers(df, F.desc("k"), F.col("_part"), name="n").collect()}
    wanted = sorted(((5 if i % 3 else i % 7), i) for i in range(3000))
    wanted.sort(key=lambda r: (-r[0], r[1]))
    assert got == {i: n + 1 for n, (_, i) in enumerate(wanted)}
    chunks = sampling.chunk_numbers(df, "k", 100).groupBy("chunk").count().collect()
    assert {r["chunk"]: r["count"] for r in chunks} == {c: 100 for c in range(1, 31)}


MENTION = "text string, entity_type string, confidence double, source string, record_id string, status string, gnd_id string, gnd_preferred string, ord long"


def mention(text, kind, conf, source, ord_, rid="r1", status="pending", gnd="", pref=""):
    return (text, kind, conf, source, rid, status, gnd, pref, ord_)


def test_merge_and_store(spark):
    a = spark.createDataFrame([mention(" Bern", "LOC", .6, "rule", 1), mention("Genf", "LOC", .9, "rule", 2)], MENTION)
    b = spark.createDataFrame([mention("bern", "LOC", .6, "model", 3), mention("genf ", "LOC", .3, "model", 4), mention("Basel", "GPE", .2, "model", 5)], MENTION)
    got = {(r["text"].strip().lower(), r["source"], r["ord"]) for r in entities.merge_extractions(a, b).collect()}
    assert got == {("bern", "hybrid", 3), ("genf", "hybrid", 2), ("basel", "model", 5)}
    stored = entities.add_mentions(a, b.withColumn("confidence", F.lit(0.95)).withColumn("text", F.trim("text")))
    assert sorted((r["text"], r["confidence"], r["source"]) for r in stored.collect()) == [
        (" Bern", .6, "rule"), ("Basel", .95, "model"), ("Genf", .95, "model"), ("bern", .95, "model")]
    again = entities.unique_mentions(entities.unique_mentions(b))
    assert again.count() == 3


def test_dictionary_and_changes(spark):
    df = spark.createDataFrame([("1", "Bern; BERN"), ("2", "bern;Genf")], "record_id string, place string")
    d = dictionary.build(dictionary.term_rows(df, ["place"], "record_id", "GPE"))
    assert sorted((r["term"], r["entity_type"]) for r in d.entries.collect()) == [("Bern", "place"), ("Genf", "place")]
    assert {r["spelling"] for r in d.spellings.collect()} == {"BERN", "bern"} and d.links.count() == 3
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, term string")
    changes = spark.createDataFrame([("a", "add", "n", 1), ("b", "update", "z", 2), ("c", "add", "new", 3), ("d", "delete", None, 4)], "key string, op string, term string, ord int")
    merged, refused = dictionary.apply_changes(base, changes, "key")
    assert sorted(map(tuple, merged.collect())) == [("a", "x"), ("b", "z"), ("c", "new")]
    assert sorted(map(tuple, refused.collect())) == [("a", "add"), ("d", "delete")]


def test_wide_table(spark):
    cols = "record_id string, named_entity_1 string, named_entity_1_gnd_id string, named_entity_1_gnd_preferredName string, named_entity_1_gnd_type string, named_entity_1_gnd_konfidenz string, named_entity_1_gnd_alternativen string, ord int"
    df = spark.createDataFrame([("r1", "Berlin", "1", "Berlin", "Place", "70%", "a; b", 1), ("r2", "Berlin", "2", "Berlin", "Place", "95%", "", 2), ("r3", "x", " ", "", "", "", "", 3)], cols)
    m = authority.wide_matches(df)
    best = dictionary.from_matches(m).collect()
    assert m.count() == 2 and (best[0]["key"], best[0]["confidence"]) == ("berlin", .95)
    assert authority.low_confidence(m).count() == 1


def maps(spark, rows):
    return spark.createDataFrame([(c, t, "", rep, "", True, i) for i, (c, t, rep) in enumerate(rows)], MAPPING)


def test_xml_exports_are_well_formed(spark):
    df = spark.createDataFrame([("o 1", "A & <B> \"C\"", "Goethe, Johann; Anna von Arnim", "Bern; Genf", "Verlag|Abt. 1|Abt. 2")], "record_id string, title string, who string, place string, pub string")
    m = maps(spark, [("title", "TitleDocMain", False), ("who", "Creator", True), ("place", "SubjectGeographic", True), ("pub", "Publisher", False)])
    terms = spark.createDataFrame([("bern", "g1", 1), ("goethe, johann", "g2", 2)], "term string, gnd_id string, ord int")
    mentions = spark.createDataFrame([mention("Rom", "GPE", 1., "m", 1, "o 1"), mention("Paul Klee", "PER", 1., "m", 2, "o 1", gnd="g9"), mention("nein", "LOC", 1., "m", 3, "o 1", "rejected")], MENTION)
    dates = spark.createDataFrame([("o 1", "date", "1920", "1920~", 1)], "record_id string, source_column string, original string, edtf string, ord long")
    xml = import_xml.record_xml(df, m, terms, mentions, dates)
    root = ElementTree.fromstring(xml.first()["xml"])
    assert root.find("data/metadata[@type='TitleDocMain']").text == 'A & <B> "C"'
    people = [(p.get("firstname"), p.get("lastname"), p.get("valueURI")) for p in root.findall("data/person")]
    assert people == [("Johann", "Goethe", "g2"), ("Anna", "von Arnim", None), ("Paul", "Klee", "g9")]
    assert [s.text for s in root.findall("data/corporate/subname")] == ["Abt. 1", "Abt. 2"]
    assert [x.text for x in root.findall("data/metadata[@type='SubjectTopic']")] == ["Rom"]
    with pytest.raises(ValueError):
        import_xml.record_xml(df, m, terms, auto_catalog_id=False)
    mods = mets.mods_records(df, m, mentions, dates)
    ElementTree.fromstring(mods.first()["mods"].replace("<mods:mods ", '<mods:mods xmlns:mods="m" ', 1))
    odd = import_xml.record_xml(df, m, terms, doc_type='A"B', journal="C & <D>").first()["xml"]
    assert ElementTree.fromstring(odd).find("process/journal").text == "C & <D>"


def test_file_names(spark, tmp_path):
    xml = spark.createDataFrame([("a 1", "<x/>"), ("b", "<y/>")], "record_id string, xml string")
    import_xml.write_files(xml, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_1.xml", "b.xml"]
    with pytest.raises(ValueError):
        import_xml.write_files(spark.createDataFrame([("a 1", "x"), ("a/1", "y")], "record_id string, xml string"), str(tmp_path / "no"))


def test_jsonld(spark):
    import json

    df = spark.createDataFrame([("o1", "T \"q\"", "a; b")], "record_id string, title string, geo string")
    mentions = spark.createDataFrame([mention("Rom", "GPE", 1., "m", 1, "o1", gnd="g1")], MENTION)
    node = json.loads(jsonld.record_nodes(df, maps(spark, [("title", "TitleDocMain", False), ("geo", "SubjectGeographic", True)]), "https://d.m/", mentions).first()["node"])
    assert node["name"] == 'T "q"' and node["@id"] == "https://d.m/o1"
    assert node["contentLocation"][:2] == ["a", "b"] and node["contentLocation"][2]["_source"] == "ner"
    with pytest.raises(ValueError):
        jsonld.check_base_url("https://example.org/x")


def test_enriched_globals_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("r1", " x"), ("r2", "y")], "record_id string, t string")
    mentions = spark.createDataFrame([mention("Rom", "GPE", 1., "m", 1, "r1"), mention("Welt", "GPE", 1., "m", 2, ""), mention("rom", "GPE", 1., "m", 3, "r1", pref="Rom")], MENTION)
    out = enriched_csv.enrich(df, mentions)
    assert {r["record_id"]: r["ner_geo_political"] for r in out.collect()} == {"r1": "Rom", "r2": "Welt"}
    common.write_csv(df, str(tmp_path / "csv"), bom=True)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert raw.startswith(b"\xef\xbb\xbf") and b" x" in raw


def test_changes_in_order_against_a_fold(spark):
    import random

    rng = random.Random(3)
    base = {f"k{i}": {"term": f"t{i}", "n": i} for i in range(12)}
    changes = [(f"k{rng.randrange(20)}", rng.choice(["add", "update", "delete"]), rng.choice([None, f"c{i}"]), rng.choice([None, 100 + i]), i) for i in range(150)]
    rows, refused = {k: dict(v) for k, v in base.items()}, []
    for key, op, term, n, _ in changes:
        if (op == "add") == (key in rows):
            refused.append((key, op))
        elif op == "delete":
            del rows[key]
        elif op == "add":
            rows[key] = {"term": term, "n": n}
        else:
            rows[key].update({k: v for k, v in (("term", term), ("n", n)) if v is not None})
    table = spark.createDataFrame([(k, v["term"], v["n"]) for k, v in base.items()], "key string, term string, n int")
    merged, left = dictionary.apply_changes(table, spark.createDataFrame(changes, "key string, op string, term string, n int, ord int"), "key")
    assert {r["key"]: {"term": r["term"], "n": r["n"]} for r in merged.collect()} == rows
    assert sorted(tuple(r) for r in left.collect()) == sorted(refused)


def test_one_image_per_name(spark):
    from collectra.operators import images

    records = spark.createDataFrame([(1, "a/scan1.jpg"), (2, "b/SCAN1.JPG"), (3, None)], "id int, path string")
    files = spark.createDataFrame([("i1", "x/scan1.jpg", 1), ("i2", "y/scan1.jpg", 2)], "image_id string, filename string, ord int")
    linked = images.link_records(records, "path", files)
    assert sorted((r["id"], r["image_id"]) for r in linked.collect()) == [(1, "i2"), (2, "i2"), (3, None)]
    assert tuple(images.link_counts(linked).first()) == (2, 3)


def test_long_chains_take_few_rounds(spark):
    """300 corrections of one value, each picking up what the one before made."""
    n = 300
    df = spark.createDataFrame([("r1", "v0"), ("r2", "v7"), ("r3", "x")], "record_id string, subject string")
    rules = [(f"s{i}", "normalize_label", f"v{i}", f"v{i + 1}", None, "subject", "accepted", i) for i in range(n)]
    schema = "suggestion_id string, action_type string, original_value string, suggested_value string, item_id string, target_field string, status string, seq long"
    out, log = remediation.apply_suggestions(df, spark.createDataFrame(rules, schema))
    assert {r["record_id"]: r["subject"] for r in out.collect()} == {"r1": f"v{n}", "r2": f"v{n}", "r3": "x"}
    assert {r["seq"]: r["n_cells"] for r in log.collect()} == {i: 1 if i < 7 else 2 for i in range(n)}
    chain = spark.createDataFrame([(i, i + 1 if i + 1 < n else None) for i in range(n)], "rid long, nxt long")
    assert len(remediation._jumps(chain)) == 9


def test_term_items_hold_the_whole_row(spark):
    from collectra.operators import model_checks
    df = spark.createDataFrame([("r1", "x" * 900, "eine Kutsche")], "record_id string, title string, note string")
    assert model_checks.term_items(df, "record_id").first()["text"].endswith("eine Kutsche")
    assert len(model_checks.term_items(df, "record_id", size=500).first()["text"]) == 500


def test_import_xml_works_its_input_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: (seen.add(1), v)[1], "string").asNondeterministic()
    df = spark.range(50, numPartitions=1).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lit("s").alias("sig"), count(F.lit("1920")).alias("date"), F.lit("x").alias("other"))
    m = maps(spark, [("sig", "CatalogIDDigital", False), ("date", "DateIssued", False)])
    terms = spark.createDataFrame([("1920?", "g1", 1)], "term string, gnd_id string, ord int")
    dates = spark.createDataFrame([("r1", "1920", "1920~", 1), ("r2", "1920", "1920?", 2)], "record_id string, original string, edtf string, ord int")
    rows = {r["record_id"]: r["xml"] for r in import_xml.record_xml(df, m, terms, dates=dates).collect()}
    assert seen.value == 50 and len(rows) == 50
    # records that differ in nothing but an id that is not mapped keep their own dates
    assert ">1920~<" in rows["r1"] and 'valueURI="g1">1920?<' in rows["r2"].replace("http://d-nb.info/gnd/", "") and ">1920<" in rows["r3"]
    only_id = m.where("ord = 0").withColumn("source_column", F.lit("record_id"))
    assert import_xml.record_xml(df, only_id, terms, dates=dates).count() == 50


def test_a_large_sparse_lookup_is_reduced_to_what_occurs(spark, monkeypatch):
    rows = spark.range(40).select(F.col("id").cast("string").alias("a"))
    lookup = spark.range(1000).select((F.col("id") + 30).cast("string").alias("part"), F.concat(F.lit("g"), "id").alias("g"))
    parts = F.array(F.struct(F.col("a").alias("part"), F.col("a").alias("name")))
    asked, join = [], common.lookup_join
    monkeypatch.setattr(common, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(common, "lookup_join", lambda big, small, *a: asked.append(small.count()) or join(big, small, *a))
    got = common.with_row_hits(rows, ["a"], parts, lookup, ["part"], "g", "hits", sparse=True).where("hits IS NOT NULL")
    assert sorted((r["a"], r["hits"]) for r in got.collect()) == [(str(i), {str(i): f"g{i - 30}"}) for i in range(30, 40)] and asked[0] == 10


def test_example_ids_are_bounded_before_they_are_sorted(spark, monkeypatch):
    rows = [(f"r{i % 700:04d}" if i % 50 else None, None if i % 3 else " x", "a;b,c" if i % 2 else "ok", "Ã¤" if i == 650 else "y" * (300 if i % 7 else 3) + " ", "full") for i in range(1500)]
    ds = profile.Dataset("d", spark.createDataFrame(rows, "id string, a string, b string, c string, d string"), "id")
    plain = sorted(map(str, checks.scan_cells(ds).collect()))
    seen, near = [], checks._near_cells
    monkeypatch.setattr(checks, "MANY_HITS", 5)
    monkeypatch.setattr(checks, "PART", 4)
    monkeypatch.setattr(checks, "_near_cells", lambda *a: seen.append(near(*a)) or seen[-1])
    assert sorted(map(str, checks.scan_cells(ds).collect())) == plain
    assert sorted(map(str, checks.scan_cells(ds, freq=checks.counts_of(ds)).collect())) == plain
    read = {r["column"]: r["count"] for r in seen[0].groupBy("column").count().collect()}
    # few rows of a and b; c has one rare kind and is read as a whole; d has no hits
    assert read["a"] < 400 and read["b"] < 400 and read["c"] == 1500 and "d" not in read
    monkeypatch.setattr(profile, "SHORT", 5)  # marks of short values are asked of the distinct values
    marks = {(r["column"], r["size"]): r["marks"] for r in checks.counts_of(ds).where("column IN ('b', 'c')").collect()}
    bit = {k: 1 << i for i, k in enumerate(checks.cell_marks())}
    assert marks == {("b", 5): bit["both_rows"], ("b", 2): 0, ("c", 301): bit["whitespace_count"], ("c", 4): bit["whitespace_count"], ("c", 2): bit["Ã¤"]}


def test_short_terms_of_long_cells_take_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: (seen.add(1), v)[1], "string").asNondeterministic()
    freq = spark.createDataFrame([("t", "Berg", 2)], "column string, value string, cnt long")
    cell_texts = [" ; ".join(["berg", "Tal", "x" * 10 * i]) for i in range(20, 25)]
    more = spark.createDataFrame([("t", t) for t in cell_texts], "column string, value string").withColumn("value", count("value"))
    got = sorted(map(tuple, checks.variant_rows(checks.variant_groups(freq, more)).collect()))
    assert got == [("t", "berg", "Berg", 2, 2), ("t", "berg", "berg", 5, 2)] and seen.value == 5
    long = spark.createDataFrame([("t", "y" * 300 + ";a"), ("t", "Y" * 300 + ";A;z"), ("t", "y" * 300 + ";" + "w" * 300)], "column string, value string")
    got = sorted(map(tuple, checks.variant_rows(checks.variant_groups(freq, long)).collect()))
    assert got == [("t", "a", "A", 1, 2), ("t", "a", "a", 1, 2), ("t", "y" * 300, "Y" * 300, 1, 2), ("t", "y" * 300, "y" * 300, 2, 2)]
