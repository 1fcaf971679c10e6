import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import documents, tables, xlsx
from millrace.streaming import watcher

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def workbook(tmp_path):
    path = tmp_path / "data.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sales" r:id="r1"/><sheet name="Other" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>customer</t></si><si><t>revenue</t></si><si><r><t>Ac</t></r><r><t>me</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>2024.0</v></c></row>'
            '<row r="3"/><row r="4"><c r="C4" t="e"><v>#DIV/0!</v></c><c r="A4" t="inlineStr"><is><t>Beta</t></is></c></row></sheetData></worksheet>',
        )
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1"><v>1.5</v></c></row></sheetData></worksheet>')
    return str(path)


def test_xlsx(spark, workbook):
    got = tables.load(spark, workbook)
    assert got.columns == ["customer", "col_1", "revenue"]
    assert sorted(map(tuple, got.collect())) == [("Acme", "TRUE", "2024"), ("Beta", None, None)]
    assert {r.sheet for r in xlsx.cells(spark, workbook).collect()} == {"Sales", "Other"}
    many = xlsx.many(spark.read.format("binaryFile").load(workbook)).where("sheet = 'Other'").collect()
    assert many[0].cells == ["1.5"]


def test_column_index():
    assert [xlsx.column_index(c) for c in ("A1", "Z9", "AA3")] == [0, 25, 26]
    assert xlsx.clean_headers(["a", None, "A", " "]) == ["a", "col_1", "A (2)", "col_3"]


def test_csv_tsv_json(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,v\nx,1\n\ny,\"2,5\"\n".encode())
    (tmp_path / "a.tsv").write_text("name\tv\nx\t1\n")
    (tmp_path / "a.json").write_text(json.dumps([{"name": "x", "v": 1, "deep": {"k": [1]}}, {"name": "y"}]))
    (tmp_path / "a.jsonl").write_text('{"name": "x"}\n{"name": "y"}\n')
    assert [tuple(r) for r in tables.load(spark, f"{tmp_path}/a.csv").collect()] == [("x", "1"), ("y", "2,5")]
    assert tables.load(spark, f"{tmp_path}/a.tsv").columns == ["name", "v"]
    assert {r.name: r.deep for r in tables.load(spark, f"{tmp_path}/a.json").collect()} == {"x": '{"k":[1]}', "y": None}
    assert tables.load(spark, f"{tmp_path}/a.jsonl").count() == 2
    with pytest.raises(ValueError):
        tables.load(spark, "a.bin")


def test_documents(spark, tmp_path):
    root = tmp_path / "kb"
    for d in ("sales", "off", ".git"):
        (root / d).mkdir(parents=True)
    (root / "sales/plan.md").write_text("---\ntitle: Plan\n---\n# One\n\nshort\n\nthis is the lead paragraph here\n\n```\n# no heading\n```\n## Two\ntext follows in this place\n")
    (root / "sales/broken.docx").write_bytes(b"not a zip")
    (root / "sales/pic.png").write_bytes(b"x")
    (root / "sales/README.md").write_text("skip me")
    (root / "off/.noindex").write_text("")
    (root / "off/a.txt").write_text("hidden")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(root / "sales/a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p></w:body></w:document>')
    (root / "sales/n.boxnote").write_text(json.dumps({"doc": {"content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"text": "Title"}]}, {"type": "paragraph", "content": [{"text": "Some"}, {"text": " words"}]}]}}))
    off = documents.noindex_folders(spark, str(root))
    assert off == ["off/"]
    files = documents.indexable(documents.listing(spark, str(root)), off=off)
    assert {r.path for r in files.collect()} == {"sales/plan.md", "sales/broken.docx", "sales/pic.png", "sales/a.docx", "sales/n.boxnote"}
    got = {r.path: r for r in documents.extract(files).collect()}
    assert got["sales/pic.png"].status == "unsupported" and got["sales/broken.docx"].status.startswith("failed")
    assert [(e.kind, e.text, e.level) for e in got["sales/a.docx"].events] == [("heading", "Head", 2), ("para", "Body text", 0)]
    assert got["sales/n.boxnote"].text == "Title\nSome words"
    sections = documents.sections(documents.extract(files.where("ext = 'md'"))).orderBy("nth").collect()
    assert [(s.heading, s.level, s.lead) for s in sections] == [("One", 1, "this is the lead paragraph here"), ("Two", 2, "text follows in this place")]


def test_front_matter(spark):
    rows = [("---\ntitle: A: b\nn: 3\n---\nx",), ("---\ntitle: A\nx",), ("x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(documents.front_matter(F.col("t"))).collect()]
    assert got == [{"title": "A: b", "n": "3"}, {}, {}]


def test_snapshot_events(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, hash string")
    assert {(r.path, r.kind) for r in watcher.snapshot_events(old, new).collect()} == {("a", "deleted"), ("b", "modified"), ("c", "created")}


def test_index_follows_events(spark, tmp_path):
    schema = "path string, kind string, ts double, event_id long, hash string"
    spark.createDataFrame([("a", "created", 1.0, 1, "x"), ("b", "created", 1.0, 2, "y"), ("a", "deleted", 2.0, 3, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    watcher.keep_in_step(spark, stream, f"{tmp_path}/index", f"{tmp_path}/ck").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/v=0").collect()] == [("b", "y")]
