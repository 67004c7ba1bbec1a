"""Readers on files written by the test."""
import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from collectra.operators import batch, checks, model_checks
from collectra.sources import csv, files, images, records, terms, workspace, xml
from collectra.streaming import incremental

MODS = """<?xml version="1.0"?><mods:modsCollection xmlns:mods="http://www.loc.gov/mods/v3">
<mods:mods><mods:titleInfo><mods:title>Ansicht von Berlin</mods:title></mods:titleInfo>
<mods:name><mods:namePart>Müller</mods:namePart><mods:namePart>Friedrich</mods:namePart><mods:role><mods:roleTerm type="text">artist</mods:roleTerm></mods:role></mods:name>
<mods:subject><mods:topic>Stadt</mods:topic><mods:geographic>Berlin</mods:geographic></mods:subject>
<mods:identifier type="uri">u1</mods:identifier><mods:identifier type="local">rec_001</mods:identifier><mods:abstract>Text</mods:abstract></mods:mods>
<mods:mods><mods:titleInfo><mods:title>Zweites</mods:title></mods:titleInfo></mods:mods></mods:modsCollection>"""


def test_encodings(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    body = "id;name\n1;Müller\n2;  N/A \n3;\"a;\nb\"\n"
    (folder / "u.csv").write_bytes(b"\xef\xbb\xbf" + body.replace("1;", "4;").encode())
    (folder / "w.csv").write_bytes((body + "9;„x“\n").encode("cp1252"))
    facts = {f["path"].rsplit("/", 1)[-1]: f for f in files.file_facts(spark, str(folder))}
    assert facts["u.csv"]["has_bom"] and facts["w.csv"]["encoding"] == "cp1252" and facts["u.csv"]["delimiter"] == ";"
    df = csv.load_csv(spark, str(folder))
    assert df.columns == ["id", "name"]
    got = {r["id"]: r["name"] for r in df.collect()}
    assert got["1"] == got["4"] == "Müller" and got["2"] is None and got["3"] == "a;\nb" and got["9"] == "„x“"
    ds, profile = csv.ingest_csv(spark, str(folder))
    assert ds.has_bom and profile.count() == 2
    assert checks.check_encoding_issues(ds).where("severity = 'info'").count() == 1
    assert files.delimiter_of("a\tb\n1\t2\n") == "\t" and files.delimiter_of("word\n") == ","
    with pytest.raises(FileNotFoundError):
        csv.load_csv(spark, str(tmp_path / "none"))


def quoted_csv(rng, rows, sep, newline):
    """Cells with breaks, doubled quotes, quotes inside plain cells and text behind a closing quote."""
    plain = ["a", "", " b ", "x y", 'in"side', 'two""', "ä", "1'2"]
    inner = ["a", "\n", "\r\n", '""', sep, " ", "ß", "line"]
    lines = [sep.join(["id", "one", "two"])]
    for i in range(rows):
        cells = [str(i)]
        for _ in range(2):
            if rng.random() < 0.5:
                cells.append(rng.choice(plain))
            else:
                cells.append('"' + "".join(rng.choice(inner) for _ in range(rng.randint(0, 12))) + '"' + rng.choice(["", "", "", "tail"]))
        lines.append(sep.join(cells))
        if rng.random() < 0.05:
            lines.append("")
    return newline.join(lines) + rng.choice(["", newline])


@pytest.mark.parametrize("block", ["60", "300", "128m"])
def test_breaks_in_quotes_in_any_block(spark, tmp_path, block):
    """The same rows as reading each file whole, wherever a file is cut."""
    rng = random.Random(11)
    folder = tmp_path / "q"
    folder.mkdir()
    seps = {"plain.csv": ";", "open.csv": ";"}
    for i, (sep, newline, charset) in enumerate([(";", "\n", "utf-8"), (",", "\r\n", "cp1252"), ("\t", "\n", "utf-8"), (";", "\r\n", "utf-8")]):
        seps[f"f {i}.csv"] = sep
        (folder / f"f {i}.csv").write_bytes(quoted_csv(rng, 120, sep, newline).encode(charset))
    (folder / "plain.csv").write_text("id;one;two\n1;2;3\n4;5\n")
    (folder / "open.csv").write_text('id;one;two\n1;2;3\n4;"5;\n6;7;8\n\n9')
    facts = files.file_facts(spark, str(folder))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        for f in facts:
            sep = seps[f["path"].rsplit("/", 1)[-1]]
            whole = spark.read.options(header=True, sep=sep, encoding=files.SPARK_NAMES[f["encoding"]], multiLine=True, escape='"', quote='"').csv(f["path"])
            whole = csv.clean_table(csv.from_latin1(whole) if f["encoding"] == "cp1252" else whole)
            found = csv.load_csv(spark, f["path"], delimiter=sep)
            assert found.columns == whole.columns
            assert sorted(found.collect(), key=str) == sorted(whole.collect(), key=str), f["path"]
        (folder / "sub").mkdir()
        for n in range(3):
            (folder / "sub" / f"{n}.csv").write_bytes(b"id;one;two\n" + b'1;"a\nb";2\n' * 40)
        assert csv.load_csv(spark, str(folder / "sub"), delimiter=";").groupBy("id", "one", "two").count().collect() == [("1", "a\nb", "2", 120)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_line_decides_by_its_quotes():
    for line, outside, inside in [("a;b", False, True), ('"a', True, False), ('"a""', True, False), ('a"b', False, False), ('"a"b;"', True, True), ('""', False, True), ('";"', False, True), ("", False, True)]:
        assert (records.ends_inside(line, False, ";"), records.ends_inside(line, True, ";")) == (outside, inside), line


def test_mods(spark, tmp_path):
    path = tmp_path / "m.xml"
    path.write_text(MODS)
    assert files.xml_format(spark, str(path)) == "mods"
    df = xml.load_xml(spark, str(path))
    rows = {r["title"]: r for r in df.collect()}
    first = rows["Ansicht von Berlin"]
    assert (first["name"], first["role"], first["subjects"], first["identifier"], first["identifier_type"]) == ("Müller, Friedrich", "artist", "Stadt; Berlin", "rec_001", "uri")
    assert rows["Zweites"]["abstract"] is None and "publisher" not in df.columns
    seen = xml.preview_xml(spark, str(path), rows=1)
    assert seen["formats"] == {"mods": 1} and seen["head"].count() == 1 and seen["columns"] == df.columns and seen["warnings"] == []
    bad = tmp_path / "x.xml"
    bad.write_text("<other/>")
    assert len(xml.preview_xml(spark, str(tmp_path))["warnings"]) == 1
    with pytest.raises(ValueError):
        xml.preview_xml(spark, str(bad))
    with pytest.raises(ValueError):
        xml.load_xml(spark, str(bad))


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        zf.writestr("one.xml", MODS)
        zf.writestr("bad.xml", "<nothing/>")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    rows, rejects = xml.load_zip(spark, str(tmp_path))
    assert rows.count() == 2 and rejects.count() == 2


def test_images(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x10\x00\x00\x00\x20")
    (tmp_path / "j.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07" + b"\x00" * 9)
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8")
    got = {r["filename"]: (r["width"], r["height"]) for r in images.scan_images(spark, str(tmp_path)).collect()}
    assert got == {"p.png": (16, 32), "j.jpg": (7, 5), "broken.jpg": (None, None)}
    # metadata before the frame header, an empty file, and files above the limit
    (tmp_path / "far.jpg").write_bytes(b"\xff\xd8" + (b"\xff\xe1\x10\x02" + b"m" * 0x1000) * 3 + b"\xff\xc2\x00\x11\x08\x00\x09\x00\x0b" + b"\x00" * 9)
    (tmp_path / "none.PNG").write_bytes(b"")
    (tmp_path / "big.tif").write_bytes(b"II*\x00" + b"x" * 20_000)
    rows = {r["filename"]: r for r in images.scan_images(spark, str(tmp_path), largest=15_000).collect()}
    assert (rows["far.jpg"]["width"], rows["far.jpg"]["height"], rows["far.jpg"]["errors"]) == (11, 9, [])
    assert (rows["none.PNG"]["size_bytes"], rows["none.PNG"]["width"], rows["none.PNG"]["errors"]) == (0, None, ["empty"])
    assert (rows["big.tif"]["mime_type"], rows["big.tif"]["hash_sha256"], rows["big.tif"]["errors"]) == ("unknown", None, ["larger than 15000 bytes"])
    assert rows["p.png"]["hash_sha256"] == hashlib.sha256((tmp_path / "p.png").read_bytes()).hexdigest()
    lost = images.scan_images(spark, str(tmp_path))  # a file that goes between listing and reading
    (tmp_path / "j.jpg").unlink()
    assert {r["filename"] for r in lost.collect()} == {"p.png", "broken.jpg", "far.jpg", "none.PNG", "big.tif"}


@pytest.mark.parametrize("doc,want", [
    (["Alt", "alt ", "Neu"], {("Alt", ""), ("Neu", "")}), ([{"term": "A", "ersatz": "B"}], {("A", "B")}), ({"x": "y", "z": {"replacement": "q"}}, {("x", "y"), ("z", "q")}),
])
def test_term_lists(spark, tmp_path, doc, want):
    path = tmp_path / "t.json"
    path.write_text("﻿" + json.dumps(doc))
    assert {(r["term"], r["replacement"]) for r in terms.read_json_terms(spark, str(path)).collect()} == want


def test_workspace_document(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"field_mapping": {"title": "TitleDocMain"}, "dates": [{"original": "1920", "edtf": "1920"}]}))
    tables = workspace.import_document(spark, str(path))
    assert tables["field_mapping"].first()["target_type"] == "TitleDocMain" and tables["dates"].count() == 1


def test_workspace_keeps_everything(spark, tmp_path):
    """Every field of every item, what nobody knows of, odd types and lists kept as objects."""
    entry = {f.split()[0]: [f"{f}1", "x"] if "array" in f else 0.5 if "double" in f else f"v {f.split()[0]}" for f in workspace.LISTS["dictionary"].split(", ")}
    one = {
        "name": "P", "source_files": ["a.csv", "b.csv"], "dictionary": {"k1": {**entry, "new": [1, {"a": None}]}, "k2": {"term": "t"}},
        "authority_candidates": [{"entry_id": "e", "extra": {"lat": 1.5, "name": "x"}}, {"entry_id": 7, "score": "no number", "status": "accepted"}],
        "tasks": [{"task_id": "t1", "priority": 2, "fill_rate": 0.25}, "a task that is a text"], "custom_mds_fields": [{"name": "f", "weight": 3}],
        "field_mapping": [{"csv_column": "c", "goobi_type": "T", "repeatable": True, "enabled": False}], "extras": {"a": {"b": [1]}, "z": None}, "ai_runs": None, "dates": "none",
    }
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two words.json").write_text(json.dumps({"name": None, "dictionary": [{"term": "other"}]}))
    (tmp_path / "bad.json").write_text("{")
    found = workspace.import_document(spark, str(tmp_path))
    terms = {(r["document"], r["ord"]): r for r in found["dictionary"].collect()}
    assert set(terms) == {("one", 0), ("one", 1), ("two words", 0)}
    assert {k: terms["one", 0][k] for k in entry} == entry and json.loads(terms["one", 0]["item"])["new"] == [1, {"a": None}]
    assert (terms["one", 1]["term"], terms["one", 1]["confidence"], terms["one", 1]["note"]) == ("t", 1.0, None)
    assert [(r["entry_id"], r["score"], r["status"], r["extra"]) for r in found["authority_candidates"].orderBy("ord").collect()] == [
        ("e", 0.0, "pending", {"lat": "1.5", "name": "x"}), ("7", 0.0, "accepted", None)]
    assert [(r["task_id"], r["priority"], r["fill_rate"], json.loads(r["item"])) for r in found["tasks"].orderBy("ord").collect()] == [("t1", 2, 0.25, one["tasks"][0]), (None, None, None, one["tasks"][1])]
    assert json.loads(found["custom_mds_fields"].first()["item"]) == {"name": "f", "weight": 3}
    assert {r["key"]: json.loads(r["item"]) for r in found["extras"].collect()} == one["extras"]
    assert {(r["document"], r["name"], r["id_column"], tuple(r["source_files"] or ())) for r in found["project"].collect()} == {
        ("one", "P", "record_id", ("a.csv", "b.csv")), ("two words", None, "record_id", ())}
    assert found["ai_runs"].count() == found["dates"].count() == 0
    workspace.save_workspace(found, str(tmp_path / "saved"))
    back = workspace.load_workspace(spark, str(tmp_path / "saved"))
    assert {n: sorted(map(str, t.collect())) for n, t in back.items() if n in found} == {n: sorted(map(str, t.collect())) for n, t in found.items() if n in back} and "tasks" in back


def test_batch_errors(spark):
    def answer(items):
        if any(i["text"] == "bad" for i in items):
            raise ValueError("no")
        return ['{"edtf": "1900"}' for _ in items]

    items = spark.createDataFrame([(str(i), "bad" if i == 3 else "ok") for i in range(10)], "record_id string, text string")
    parsed = batch.with_parsed(batch.run_items(items, answer, workers=2))
    report = batch.batch_report(parsed).first()
    assert (report["total"], report["succeeded"], report["failed"]) == (10, 9, 1)
    done = parsed.where("success")
    assert batch.pending_items(items, done, ["record_id"]).count() == 1


def test_incremental_goes_on(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.range(20).select(F.col("id").cast("string").alias("record_id"), F.lit("1920").alias("text"), F.col("id").alias("ord"))
    frame.repartition(4).write.parquet(source)
    schema = "record_id string, text string, ord long"
    first = incremental.run_incremental(spark, source, schema, model_checks.hybrid_dates, out, 2).first()
    assert (first["chunk_count"], first["processed_rows"], first["error_rows"]) == (2, 20, 0)
    frame.limit(3).coalesce(1).write.mode("append").parquet(source)
    again = incremental.run_incremental(spark, source, schema, lambda df: df.select(F.raise_error(F.lit("x")).alias("a")), out, 2).first()
    assert (again["processed_rows"], again["error_rows"]) == (23, 3) and incremental.results(spark, out).count() == 20


def test_headers_and_encodings_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title\n1,Alpha\n")
    (tmp_path / "b.csv").write_text("title,id\nBeta,2\n")
    (tmp_path / "c.csv").write_bytes("id,title\n3,Müller\n".encode())
    (tmp_path / "d.csv").write_bytes(b"id,title\n" + b"".join(b"%d,x\n" % i for i in range(10, 3000)) + "4,Zürich\n".encode("cp1252"))
    got = {r["id"]: r["title"] for r in csv.load_csv(spark, str(tmp_path)).collect()}
    assert (got["1"], got["2"], got["3"], got["4"]) == ("Alpha", "Beta", "Müller", "Zürich") and len(got) == 2994


def test_mixed_xml_folder(spark, tmp_path):
    (tmp_path / "m.xml").write_text(MODS)
    (tmp_path / "l.xml").write_text(
        '<lido:lido xmlns:lido="http://www.lido-schema.org"><lido:administrativeMetadata><lido:recordWrap><lido:recordID>L1</lido:recordID>'
        "</lido:recordWrap></lido:administrativeMetadata></lido:lido>")
    df = xml.load_xml(spark, str(tmp_path))
    assert df.count() == 3 and {r["record_id"] for r in df.collect()} >= {"L1"}
    (tmp_path / "x.xml").write_text("<other/>")
    with pytest.raises(ValueError):
        xml.load_xml(spark, str(tmp_path))
    assert xml.load_xml(spark, str(tmp_path), skip_unknown=True).count() == 3


def test_zip_members_by_their_own_rules(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        zf.writestr("good.xml", MODS)
        zf.writestr("broken.xml", "<mods><titleInfo><title>x</mods>")
        zf.writestr("commented.xml", "<list><!-- <mods><titleInfo><title>no</title></titleInfo></mods> --><mods><titleInfo><title>yes</title></titleInfo></mods></list>")
        zf.writestr("latin.xml", '<?xml version="1.0" encoding="ISO-8859-1"?><mods><titleInfo><title>Zürich</title></titleInfo></mods>'.encode("latin-1"))
    rows, rejects = xml.load_zip(spark, str(tmp_path))
    assert {r["title"] for r in rows.collect()} == {"Ansicht von Berlin", "Zweites", "yes", "Zürich"}
    assert [r["member"] for r in rejects.collect()] == ["broken.xml"]


def test_only_the_first_line_is_a_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("term,replacement\nalt,neu\nwort,begriff\n")
    (tmp_path / "u.csv").write_text("kurz,lang\nterm,x\n")
    assert {r["term"] for r in terms.read_csv_terms(spark, str(tmp_path)).collect()} == {"alt", "wort", "kurz", "term"}


def test_each_item_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"

    def answer(items):
        with open(log, "a") as fh:
            fh.write("x\n" * len(items))
        return ['{"unclassified": ["a"], "classifications": [{"term": "b", "confidence": 0.1}]}'] * len(items)

    items = spark.createDataFrame([(str(i), "subject", f"t{i}") for i in range(10)], "record_id string, source_column string, text string")
    parsed = batch.answer_table(items, answer)
    model_checks.subject_findings(parsed, "subject").collect()
    model_checks.subject_findings(parsed, "subject").count()
    assert log.read_text().count("x") == 10
    path = str(tmp_path / "answers")
    assert batch.answer_table(items.limit(4), answer, "p", path).count() == 4
    assert batch.answer_table(items, answer, "p", path).count() == 10 and log.read_text().count("x") == 20
    batch.answer_table(items, answer, "other prompt", path)
    assert log.read_text().count("x") == 30


def test_a_stopped_run_keeps_its_steps(spark, tmp_path):
    """The first run dies in its fifth step; the second asks exactly what the first has not committed."""
    from pyspark.errors import StreamingQueryException

    log, path = tmp_path / "asked", str(tmp_path / "kept")

    def answer(rows):
        with open(log, "a") as fh:
            fh.write("".join(f"{r['record_id']}\n" for r in rows))
        return ['{"ok": true}' for _ in rows]

    def dies(rows):
        if any(int(r["record_id"]) >= 43 for r in rows):
            raise SystemExit(3)  # what a killed worker looks like
        return answer(rows)

    items = spark.createDataFrame([(f"{i:02d}", i, "r") for i in range(60)], "record_id string, step int, run string").coalesce(1)
    with pytest.raises(StreamingQueryException):
        batch.answer_table(items, dies, "p", path, step=10, files=1, workers=1)
    first = log.read_text().split()
    kept = {r["record_id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/answers").collect()}
    assert kept == {f"{i:02d}" for i in range(40)} and set(first) >= kept
    log.write_text("")
    done = batch.answer_table(items, answer, "p", path, step=10, files=2)
    assert sorted(log.read_text().split()) == [f"{i:02d}" for i in range(40, 60)]
    assert done.columns[:4] == ["record_id", "step", "run", "item_key"] and sorted(r["record_id"] for r in done.collect()) == [f"{i:02d}" for i in range(60)]
    batch.answer_table(items, answer, "p", path)
    assert len(log.read_text().split()) == 20
    assert batch.answer_table(items.limit(0), answer, "q", str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 40, 41, 100])
def test_documents_of_one_task_are_bounded(spark, tmp_path, monkeypatch, n):
    """One task writes several whole documents, none longer than its lines, with each record once."""
    from xml.etree import ElementTree

    from collectra.sinks import common, mets

    monkeypatch.setattr(common, "LINES", 4)
    monkeypatch.setattr(common, "LINE_SIZE", 1000)
    rows = spark.range(n).coalesce(1).select(F.concat(F.lit("r"), "id").alias("record_id"), F.rpad(F.concat(F.lit("<x>"), "id", F.lit("</x>")), 100, " ").alias("xml"))
    common.write_documents(rows, str(tmp_path / "plain"), "<all>", "</all>")
    mets.write_mets(rows.withColumnRenamed("xml", "mods"), str(tmp_path / "mets"))
    common.write_documents(rows.select(F.to_json(F.struct("record_id", F.rpad(F.lit(""), 100, "z"))).alias("xml")), str(tmp_path / "json"), "[", "]", between=",")
    plain = [ElementTree.fromstring(f.read_bytes()) for f in (tmp_path / "plain").glob("part*")]
    assert sorted(int(x.text) for d in plain for x in d) == list(range(n)) and len(plain) == max(1, -(-n // 40)) and all(len(d) <= 40 for d in plain)
    nested = [ElementTree.fromstring(f.read_bytes()) for f in (tmp_path / "mets").glob("part*")]
    for d in nested:
        ids = [e.get("ID") for e in d.iter("{http://www.loc.gov/METS/}dmdSec")]
        assert ids == [e.get("DMDID") for e in d.iter("{http://www.loc.gov/METS/}div") if e.get("DMDID")]
    assert sum(len(list(d.iter("x"))) for d in nested) == n and (n < 100 or len(nested) > 2)
    assert sorted(r["record_id"] for f in (tmp_path / "json").glob("part*") for r in json.loads(f.read_text())) == sorted(f"r{i}" for i in range(n))


def test_compressed_documents(spark, tmp_path):
    """Documents written with gzip load like plain ones, and a file that only bears the name is of no known kind."""
    import gzip

    from collectra.sinks import common, mets

    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<lido:lidoWrap xmlns:lido="http://www.lido-schema.org">', "</lido:lidoWrap>"
    record = "<lido:lido><lido:administrativeMetadata><lido:recordWrap><lido:recordID>L{}</lido:recordID></lido:recordWrap></lido:administrativeMetadata></lido:lido>"
    rows = spark.range(50).select(F.concat(F.lit("r"), "id").alias("record_id"), F.concat(F.lit(record[:record.index("{")]), "id", F.lit(record[record.index("}") + 1:])).alias("xml"))
    common.write_documents(rows, str(tmp_path / "in" / "lido"), head, tail, compression="gzip")
    mods = rows.select("record_id", F.concat(F.lit("<mods:mods><mods:titleInfo><mods:title>T"), "record_id", F.lit("</mods:title></mods:titleInfo></mods:mods>")).alias("mods"))
    mets.write_mets(mods, str(tmp_path / "in" / "mets"), compression="gzip")
    written = [f for f in (tmp_path / "in").rglob("part*")]
    assert written and all(f.name.endswith(".gz") and gzip.decompress(f.read_bytes()).startswith(b"<?xml") for f in written)
    wanted = sorted([(f"L{i}", None) for i in range(50)] + [(None, f"Tr{i}") for i in range(50)], key=str)
    assert sorted(map(tuple, xml.load_xml(spark, str(tmp_path / "in")).select("record_id", "title").collect()), key=str) == wanted
    (tmp_path / "in" / "plain.xml.gz").write_text(head + tail)
    assert [f.rpartition("/")[2] for f in files.xml_formats(spark, str(tmp_path / "in"))["unknown"]] == ["plain.xml.gz"]


def test_derived_documents_take_little_disk(spark):
    """The documents that a loading query writes for itself are far smaller than their text."""
    import os

    from collectra.plans import ingest

    given = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{given}/orders.parquet").count()
    for write in (ingest._lido, ingest._mets):
        folder = write(spark, given)
        assert sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.startswith("part")) < 150 * n


def test_steps_of_a_long_run_grow(spark, tmp_path, monkeypatch):
    """The number of steps has a bound, whatever the number of items; each is asked once, in no more files than that."""
    monkeypatch.setattr(batch, "MAX_STEPS", 3)
    monkeypatch.setattr(batch, "MAX_FILES", 8)
    path, items = str(tmp_path / "kept"), spark.range(200).select(F.col("id").cast("string").alias("record_id")).coalesce(1)
    done = batch.answer_table(items, lambda rows: ["{}"] * len(rows), "p", path, step=2, files=1, workers=1)
    assert sorted(int(r["record_id"]) for r in done.collect()) == list(range(200))
    assert len(list(tmp_path.glob("kept/queue/*/*.parquet"))) == 8 and len(list(tmp_path.glob("kept/answers/*/*"))) == 3


def test_a_failed_step_keeps_its_finished_tasks(spark, tmp_path):
    """Two tasks of one step: one ends, then the other dies. The next run asks only for what the second had."""
    import os
    import time

    from pyspark.errors import StreamingQueryException

    path = str(tmp_path / "kept")

    def dies(rows):
        if any(r["record_id"] == "0" for r in rows):
            for _ in range(200):
                if any(f.endswith(".parquet") for _, _, names in os.walk(f"{path}/answers") for f in names):
                    break
                time.sleep(0.1)
            time.sleep(2)
            raise SystemExit(3)
        return ["{}"] * len(rows)

    items = spark.range(100).select(F.col("id").cast("string").alias("record_id")).coalesce(1)
    with pytest.raises(StreamingQueryException):
        batch.answer_table(items, dies, "p", path, step=100, files=1, workers=2)
    kept = batch.stored_answers(batch.with_item_keys(items, "p"), path).count()
    assert 0 < kept < 100
    assert batch.answer_table(items, lambda rows: ["{}"] * len(rows), "p", path).count() == 100


def test_archives_grow_in_number_and_leave_in_groups(spark, tmp_path, monkeypatch):
    """Members leave a task in groups by number and size, each once; more rows make more archives."""
    from collectra.plans import ingest

    monkeypatch.setattr(xml, "MEMBERS", 3)
    monkeypatch.setattr(xml, "MEMBER_CHARS", 40)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        for i in range(20):
            zf.writestr(f"{i:02d}.xml", "<broken" if i == 7 else f"<a>{'x' * (i * 5)}</a>")
    rows = {r["member"]: r for r in xml.zip_members(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [f"{i:02d}.xml" for i in range(20)] and rows["07.xml"]["xml"] is None and rows["07.xml"]["error"]
    assert all(rows[f"{i:02d}.xml"]["xml"] == f"<a>{'x' * (i * 5)}</a>" for i in range(20) if i != 7)
    monkeypatch.setattr(ingest, "ZIP_MEMBERS", 10)
    folder = ingest._zips(spark, "/root/testdata/sf0.001")
    names = [r["member"] for r in xml.zip_members(spark, folder).select("member").collect()]
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert len(names) == len(set(names)) == customers and len(files.list_files(spark, folder)) > 4


def test_many_images_are_listed_once_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    for i in range(1200):
        (tmp_path / "deep" / f"i {i}.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x10\x00\x00\x00\x20" if i % 100 else b"")
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
    empty = files.list_files(spark, str(tmp_path), (".png",), only_empty=True)
    assert len(empty) == 12 and empty[0] == f"file:{tmp_path}/deep/i 0.png" and len(calls) < 100
    assert files.list_files(spark, empty[0]) == empty[:1]
    monkeypatch.undo()
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert images._fewer_tasks(read).rdd.getNumPartitions() < read.rdd.getNumPartitions()
    rows = images.scan_images(spark, str(tmp_path)).groupBy("width", "errors").count().collect()
    assert {(r["width"], tuple(r["errors"])): r["count"] for r in rows} == {(16, ()): 1188, (None, ("empty",)): 12}


def test_dates_without_a_model_take_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: (seen.add(1), v)[1], "string").asNondeterministic()
    texts = ["1920", "ca. 1920", None, " ", "keine Ahnung 5", "o.D."]
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "record_id string, text string, ord long").withColumn("text", count("text"))
    rows = [tuple(r)[2:] for r in sorted(model_checks.hybrid_dates(df).collect(), key=lambda r: r["ord"])]
    assert seen.value == len(texts)
    assert rows[0][:2] == ("1920", "1920") and rows[2][:2] == rows[3][:2] == ("", "") and all(r[-1] for r in rows[:4])
    assert rows[4] == ("keine Ahnung 5", "", 0.0, "rule", "Kein Muster erkannt — LLM deaktiviert", False)


def test_files_of_the_incremental_run_grow_in_number(spark, monkeypatch):
    from collectra.plans import models

    run, taken = incremental.run_incremental, []
    monkeypatch.setattr(models, "FILE_ROWS", 100)
    monkeypatch.setattr(incremental, "run_incremental", lambda *a, **k: taken.append(k["files_per_batch"]) or run(*a, **k))
    log = models.incremental_run_log(spark, "/root/testdata/sf0.001").first()
    assert taken[0] > 2 and (log["chunks"], log["errors"]) == (3, 0)
