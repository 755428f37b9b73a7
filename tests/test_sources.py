"""Files made of bytes in the tests, read back."""

import json
import zipfile

import pytest

from pagewright import models, sinks
from pagewright.plans import pipelines, q_sources, stage
from pagewright.plans.settings import Settings
from pagewright.sources import binary, office
from pagewright.sources import csv as csv_source

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def write(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_word(spark, tmp_path):
    picture = '<w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r>'
    link = '<w:r><w:instrText>HYPERLINK "https://x.example/a" </w:instrText></w:r>'
    cell = lambda *p: "<w:tc>" + "".join(f"<w:p>{run(x)}</w:p>" for x in p) + "</w:tc>"
    wide = '<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>' + run("wide") + "</w:p></w:tc>"
    body = f"<w:p>{run('before')}{picture}{run(' after ')}</w:p><w:p>{link}{run('here')}</w:p><w:p/><w:tbl><w:tr>{cell('h1')}{cell('h2')}{cell('h3')}</w:tr><w:tr>{wide}{cell('x', 'x', 'y')}</w:tr></w:tbl>"
    write(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="media/image1.png"/></Relationships>', "word/media/image1.png": b"png"})
    got = [(r.chunk_type, r.content) for r in office.read_word(spark, str(tmp_path)).orderBy("index").collect()]
    assert got[:4] == [("text", "before"), ("image", "![image_1](images/image1.png)"), ("text", "after"), ("text", "[here](https://x.example/a)")]
    assert got[4] == ("table_csv", "| h1 | h2 | h3 |\n| --- | --- | --- |\n| wide |  | x y |")


def test_pictures_outside_of_the_file(spark, tmp_path):
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = f'<Relationship Id="r1" Type="{kind}/hyperlink" Target="https://x.example" TargetMode="External"/><Relationship Id="r2" Type="{kind}/image" Target="https://x.example/a.png" TargetMode="External"/>'
    body = '<w:p><w:r><w:drawing><a:blip r:link="r2"/></w:drawing></w:r></w:p>'
    write(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": f"<Relationships {REL}>{rels}</Relationships>"})
    got = office.read_word(spark, str(tmp_path)).collect()
    assert [(r.chunk_type, r.content, r.image_name, r.image_content) for r in got] == [("image", "![image_1](https://x.example/a.png)", "image_1", None)]


def test_excel(spark, tmp_path):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    one = f'<worksheet {s}><sheetData><row r="1">{cell("A1", "k")}{cell("B1", "v")}</row><row r="2">{cell("A2", "a")}<c r="B2"><v>3</v></c></row><row r="3"/><row r="4">{cell("B4", "only")}</row></sheetData><hyperlinks><hyperlink ref="A2" r:id="l"/></hyperlinks></worksheet>'
    write(
        tmp_path / "a.xlsx",
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": one,
            "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {REL}><Relationship Id="l" Target="https://x.example" TargetMode="External"/></Relationships>',
            "xl/worksheets/sheet2.xml": f"<worksheet {s}><sheetData/></worksheet>",
        },
    )
    got = [(r.sheet, r["index"], r.content) for r in office.read_excel(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("S1", 0, '"k":"[a](https://x.example)";"v":"3"'), ("S1", 2, '"v":"only"')]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n1,2\n1,2,3,4\nx,,z\n")
    got = [r.content for r in csv_source.read_exact(spark, str(tmp_path)).orderBy("index").collect()]
    assert got == ["a: 1;b: 2.0;c: 3", "a: 1;b: 2.0;c: nan", "a: x;b: nan;c: z"]
    assert [tuple(r) for r in csv_source.read(spark, str(tmp_path / "a.csv")).collect()] == [("1", "2", "3"), ("1", "2", None), ("x", None, "z")]
    bad = csv_source.read_exact(spark, str(tmp_path), source_column="none").collect()
    assert [r.chunk_type for r in bad] == ["error"]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(("Les élèves français étaient très fatigués après la fête. " * 5).encode("latin-1"))
    got = {r.source[-5:]: r.content for r in binary.read_text(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "é" and "fatigu" in got["b.txt"]  # short texts of one byte a letter can be taken for a neighbouring code page
    named = {r.source[-5:]: r.content for r in binary.read_text(spark, str(tmp_path / "b.txt"), "latin-1").collect()}
    assert "élèves" in named["b.txt"]
    f = binary.files(spark, str(tmp_path), "a.txt")
    assert f.select(binary.detect_encoding(f.content).alias("e")).first().e[0].encoding == "utf_8"


def test_models_are_explicit(spark):
    with pytest.raises(models.NotAvailable, match="layout model"):
        models.run("layout_detection", spark.range(1))
    models.plug("transcription", lambda df: df.selectExpr("cast(id as string) as path", "'words' as summary"))
    try:
        assert models.run("transcription", spark.range(1)).first().summary == "words"
    finally:
        models.unplug("transcription")
    with pytest.raises(KeyError):
        models.plug("nothing", lambda df: df)


def test_stages(spark):
    seen = stage.Timings()
    double = stage.Stage("double", lambda docs: docs.selectExpr("id * 2 as id"))
    p = double | double | stage.Stage("count", lambda docs: docs.groupBy().count(), ("docs",), ("n",))
    out = p.run({"docs": spark.range(3)}, [seen])
    assert sorted(r.id for r in out["docs"].collect()) == [0, 4, 8] and out["n"].first()[0] == 3
    assert set(seen.seconds) == {"double", "count"}
    with pytest.raises(ValueError, match="needs"):
        p.run({"other": spark.range(1)})
    assert len(p.stages) == 3 and len((p | double).stages) == 4
    both = stage.Parallel((stage.Stage("a", lambda docs: docs, ("docs",), ("x",)), stage.Stage("b", lambda docs: docs, ("docs",), ("y",))))
    assert {"x", "y"} <= set(both({"docs": spark.range(1)}))


def test_stored_tables_of_parallel_stages(spark, tmp_path):
    seen = stage.Timings()
    some = lambda name, k: stage.Stage(name, lambda docs: docs.selectExpr(f"id * {k} as id"), ("docs",), (name,), True)
    both = stage.Pipeline((stage.Parallel((some("x", 2), some("y", 3), stage.Stage("z", lambda docs: docs, ("docs",), ("z",)))),))
    out = both.run({"docs": spark.range(4)}, [seen], store=str(tmp_path / "store"))
    assert {k: sorted(r.id for r in out[k].collect()) for k in "xyz"} == {"x": [0, 2, 4, 6], "y": [0, 3, 6, 9], "z": [0, 1, 2, 3]}
    assert set(seen.stored) == {("parallel", "x"), ("parallel", "y")} and all(v > 0 for v in seen.stored.values())
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["0-parallel-x", "0-parallel-y"]


def test_settings(spark):
    spark.conf.set("pagewright.ocr_all_pages", "true")
    try:
        assert Settings.of(spark).ocr_all_pages is True and Settings().ocr_all_pages is False
    finally:
        spark.conf.unset("pagewright.ocr_all_pages")


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "c0", "text"), (1, 1, "c1", "more")], "doc_id long, index int, chunk_id string, content string")
    docs = spark.createDataFrame([(1, 2)], "doc_id long, num_chunks int")
    body = json.loads(sinks.document_json(docs, chunks).first().json)
    assert body["code"] == 200 and [c["content"] for c in body["data"]["chunks"]] == ["text", "more"]
    sinks.write_chunks(chunks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    names = spark.createDataFrame([("../../etc/passwd",), ("a b.txt",)], "n string")
    assert [r[0] for r in names.select(sinks.safe_name(names.n)).collect()] == ["passwd", "a b.txt"]


def test_dump_query_depends_on_the_dump(spark, data, monkeypatch):
    whole = sinks.dump

    def lossy(tables, path, **options):
        whole({k: df.filter("not (doc_id = 3 and span_id = '0_0')") for k, df in tables.items()}, path, **options)

    want = {(r.doc_id, r.pnum): r.n for r in q_sources.dump_spans(spark, data).collect()}
    monkeypatch.setattr(sinks, "dump", lossy)
    assert {(r.doc_id, r.pnum): r.n for r in q_sources.dump_spans(spark, data).collect()} == want | {(3, 0): want[3, 0] - 1}


def test_files_that_cannot_be_read(spark, tmp_path):
    for name, read in (("a.xlsx", office.read_excel), ("a.docx", office.read_word)):
        folder = tmp_path / name[2:]
        folder.mkdir()
        (folder / f"plain{name[1:]}").write_bytes(b"plain bytes")
        (folder / f"empty{name[1:]}").write_bytes(b"")
        write(folder / f"bare{name[1:]}", {"other.xml": "<x/>"})
        write(folder / f"torn{name[1:]}", {"xl/workbook.xml": "<a", "word/document.xml": "<a"})
        write(folder / f"hollow{name[1:]}", {"xl/workbook.xml": "<workbook/>", "word/document.xml": "<x/>"})
        whole = (folder / f"torn{name[1:]}").read_bytes()
        for k in (10, 40, len(whole) // 2, len(whole) - 5):
            (folder / f"cut{k}{name[1:]}").write_bytes(whole[:k])
        rows = read(spark, str(folder)).collect()
        assert {r.chunk_type for r in rows} == {"error"} and all(r.content for r in rows)
        assert len(rows) == (8 if name == "a.docx" else 7)  # no row for the empty file, nor for a workbook without sheets
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,\xe9\n")
    assert [(r.chunk_type, r.content) for r in csv_source.read_exact(spark, str(tmp_path / "a.csv"), "utf-8").collect()] == [("error", "no encoding fits")]
    assert [r.content for r in csv_source.read_exact(spark, str(tmp_path / "a.csv"), "latin-1").collect()] == ["a: 1;b: é"]
    (tmp_path / "blank.csv").write_bytes(b"\n")
    assert [r.chunk_type for r in csv_source.read_exact(spark, str(tmp_path / "blank.csv")).collect()] == ["error"]
    (tmp_path / "a.txt").write_bytes(b"\xe9")
    assert [(r.chunk_type, r.content) for r in binary.read_text(spark, str(tmp_path / "a.txt"), "utf-8").collect()] == [("error", "no encoding fits")]
    with pytest.raises(LookupError):
        binary.read_text(spark, str(tmp_path / "a.txt"), "no-such-encoding")


def test_dispatch(spark):
    f = spark.createDataFrame([("/a/x.csv",), ("/a/x.PDF",), ("/a/x",)], "path string")
    assert {r.path: r.pipeline for r in pipelines.dispatch(f).collect()} == {"/a/x.csv": "csv", "/a/x.PDF": None, "/a/x": None}
