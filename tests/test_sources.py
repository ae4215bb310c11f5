import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import versions
from quire.sources import docx, generations, records
from quire.streaming import resume

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{paragraph('a')}</w:tc><w:tc>{paragraph('b')}</w:tc></w:tr></w:tbl>"
    body = paragraph("Scope", "Heading1") + paragraph("First.") + table + paragraph("Rules", "Heading2") + paragraph("Second.")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{paragraph('DRAFT')}</w:hdr>")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    found = docx.read(spark, str(tmp_path))
    rows = found.orderBy("file", "ordinal").collect()
    assert rows[0].error.startswith("BadZipFile")
    assert [(r.kind, r.level, r.text) for r in rows[1:]] == [("heading", 1, "Scope"), ("text", None, "First."), ("table", None, "a | b"), ("heading", 2, "Rules"), ("text", None, "Second."), ("header", None, "DRAFT")]
    assert [r.text for r in docx.pages(found).orderBy("page").collect()] == ["Scope\nFirst.", "Rules\nSecond."]


REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
FULL = NS + f' xmlns:r="{REL}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def relations(*rows):
    made = "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"{" TargetMode=" + chr(34) + "External" + chr(34) if kind == "hyperlink" else ""}/>' for i, kind, target in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{made}</Relationships>'


def cell(text, span=None, merge=None):
    props = (f'<w:gridSpan w:val="{span}"/>' if span else "") + (f'<w:vMerge w:val="{merge}"/>' if merge == "restart" else "<w:vMerge/>" if merge else "")
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{paragraph(text)}</w:tc>"


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    """The blocks of one file with all that a package can hold, named as nothing but its relationships tell."""
    folder = tmp_path_factory.mktemp("package")
    box = f"<w:txbxContent>{paragraph('boxed')}</w:txbxContent>"
    table = "<w:tbl>" + "".join(f"<w:tr>{row}</w:tr>" for row in (cell("head", 2) + cell("x"), cell("a", merge="restart") + cell("b") + cell("c"), cell("a2", merge="on") + cell("d") + cell("e"), cell("f", merge="restart") + cell("g", 2))) + "</w:tbl>"
    body = (
        paragraph("Scope", "S1") + f'<w:p><w:r><w:t>see </w:t></w:r><w:hyperlink r:id="r9"><w:r><w:t>the site</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="mark"><w:r><w:t>below</w:t></w:r></w:hyperlink><w:hyperlink r:id="none"><w:r><w:t>dead</w:t></w:r></w:hyperlink></w:p>'
        + f"<w:p><w:r><w:t>around</w:t><w:tab/><w:sym w:font=\"W\" w:char=\"F0A8\"/><w:br/><w:checkBox><w:checked w:val=\"0\"/></w:checkBox><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent></w:r></w:p>"
        + f"<w:sdt><w:sdtContent>{paragraph('controlled')}</w:sdtContent></w:sdt>" + table + paragraph("  ") + "<w:sectPr/>"
    )
    with zipfile.ZipFile(folder / "x.docx", "w") as z:
        z.writestr("_rels/.rels", relations(("r1", "officeDocument", "word/main.xml")))
        z.writestr("word/main.xml", f"<w:document {FULL}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/main.xml.rels", relations(("r1", "styles", "looks.xml"), ("r2", "header", "top.xml"), ("r3", "endnotes", "/word/ends.xml"), ("r4", "footnotes", "feet.xml"), ("r9", "hyperlink", "https://example.org/a"), ("r5", "image", "media/i.png")))
        z.writestr("word/looks.xml", f'<w:styles {NS}><w:style w:styleId="S1"><w:name w:val="Heading 3"/></w:style><w:style w:styleId="S2"/></w:styles>')
        z.writestr("word/top.xml", f"<w:hdr {FULL}>{paragraph('INTERNAL', 'S1')}</w:hdr>")
        z.writestr("word/header4.xml", f"<w:hdr {NS}>{paragraph('fourth')}</w:hdr>")
        z.writestr("word/feet.xml", f"<w:footnotes {NS}><w:footnote>{paragraph('a note')}</w:footnote></w:footnotes>")
        z.writestr("word/ends.xml", f'<w:endnotes {FULL}><w:endnote><w:p><w:hyperlink r:id="e1"><w:r><w:t>end</w:t></w:r></w:hyperlink></w:p></w:endnote></w:endnotes>')
        z.writestr("word/_rels/ends.xml.rels", relations(("e1", "hyperlink", "https://example.org/end")))
    return docx.read(spark, str(folder))


def test_docx_parts(package):
    rows = package.orderBy("ordinal").collect()
    assert [(r.part.rpartition("/")[2], r.kind, r.level, r.text) for r in rows if r.kind != "table"] == [
        ("main.xml", "heading", 3, "Scope"), ("main.xml", "text", None, "see the sitebelowdead"), ("main.xml", "text", None, "around\t[symbol:W:F0A8]\n[checkbox:0]"), ("main.xml", "textbox", None, "boxed"), ("main.xml", "text", None, "controlled"),
        ("ends.xml", "footnote", None, "end"), ("feet.xml", "footnote", None, "a note"), ("header4.xml", "header", None, "fourth"), ("top.xml", "header", 3, "INTERNAL"),
    ]
    assert len({r.element + r.part for r in rows}) == len(rows) and rows[0].element == "/w:document/w:body/*[1]"


def test_docx_links(package):
    rows = package.where("size(links) > 0").orderBy("ordinal").collect()
    assert [[(x.text, x.target) for x in r.links] for r in rows] == [[("the site", "https://example.org/a"), ("below", "#mark")], [("end", "https://example.org/end")]]


def test_docx_tables(package):
    table = package.where("kind = 'table'").first()
    assert table.text == "head | x\na | b | c\na2 | d | e\nf | g" and [[(c.text, c.column_span, c.vertical_merge) for c in r] for r in table.rows][2] == [("a2", 1, "continue"), ("d", 1, None), ("e", 1, None)]
    got = {(r.row, r.column): (r.text, r.column_span, r.row_span) for r in docx.cells(package).collect()}
    assert got == {
        (0, 0): ("head", 2, 1), (0, 2): ("x", 1, 1), (1, 0): ("a\na2", 1, 2), (1, 1): ("b", 1, 1), (1, 2): ("c", 1, 1), (2, 1): ("d", 1, 1), (2, 2): ("e", 1, 1), (3, 0): ("f", 1, 1), (3, 1): ("g", 2, 1),
    }


def test_docx_damaged_files(spark, tmp_path):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{paragraph('text ' * 500)}</w:body></w:document>")
    data = bytearray(whole.getvalue())
    (tmp_path / "good.docx").write_bytes(data)
    at = data.index(b"word/document.xml") + 17
    (tmp_path / "stream.docx").write_bytes(data[:at] + b"\xff" * 20 + data[at + 20 :])
    (tmp_path / "short.docx").write_bytes(data[:40])
    locked = bytearray(data)
    for mark, flags in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + flags] |= 1
    (tmp_path / "locked.docx").write_bytes(locked)
    with zipfile.ZipFile(tmp_path / "nobody.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}/>")
    with zipfile.ZipFile(tmp_path / "xml.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document")
    good, bad = docx.divided(docx.required(docx.read(spark, str(tmp_path))))
    assert [r.file.rpartition("/")[2] for r in good.collect()] == ["good.docx"]
    errors = {r.file.rpartition("/")[2]: r.error for r in bad.collect()}
    assert set(errors) == {"stream.docx", "short.docx", "locked.docx", "nobody.docx", "xml.docx"} and "encrypted" in errors["locked.docx"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        docx.required(docx.read(spark, f"{tmp_path}/none"))


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    one, two = spark.range(3), spark.range(5)
    first = generations.publish(spark, root, {"chunks": one})
    assert generations.active(spark, root) == first
    generations.publish(spark, root, {"chunks": two}, preview=True)
    assert generations.read(spark, root, "chunks").count() == 3
    with pytest.raises(ValueError):
        generations.publish(spark, root, {"chunks": two}, check=lambda t: t["chunks"].where("id > 3"))
    assert generations.read(spark, root, "chunks").count() == 3
    generations.publish(spark, root, {"chunks": two})
    assert generations.read(spark, root, "chunks").count() == 5


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("q,1", 'say "x"', "n"), ("q2", None, None)], "q string, a string, note string")
    records.write_csv(rows, f"{tmp_path}/csv")
    assert {tuple(r) for r in records.read_csv(spark, f"{tmp_path}/csv", "q string, a string, note string").collect()} == {("q,1", 'say "x"', "n"), ("q2", None, None)}
    records.write_lines(rows, f"{tmp_path}/lines")
    assert records.read_lines(spark, f"{tmp_path}/lines", "q string, a string").count() == 2
    again = records.carried(rows.drop("note").withColumn("note", F.lit("")), rows, ["q"], ["note"])
    assert {r.q: r.note for r in again.collect()} == {"q,1": "n", "q2": None}


def test_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    go = lambda: resume.drain(spark, f"{tmp_path}/in", "id int, text string", lambda d: d.withColumn("n", F.length("text")), f"{tmp_path}/out", "id", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i, "text": "x" * i}) for i in (1, 2, 2)))
    go()
    (tmp_path / "in/b.json").write_text("\n".join(json.dumps({"id": i, "text": "x" * i}) for i in (2, 3)))
    go()
    assert sorted((r.id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1), (2, 2), (3, 3)]


def test_scopes_are_monotone(spark):
    rows = spark.createDataFrame([(c, s) for c in versions.CLASSES for s in ("active", "review", "archived")], "classification string, status string")
    see = lambda *a: {tuple(r) for r in rows.where(versions.permitted(*a)).collect()}
    assert see(["public"], False, False) == {("public", "active")}
    assert see(["public"], False, False) < see(["public"], True, False) < see(["public", "internal"], True, True) < see(list(versions.CLASSES), True, True)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    spans = one(tx.token_spans(F.lit(" é1, x")))
    assert [(s.start, s.end) for s in spans] == [(1, 3), (3, 4), (5, 6)]
    assert one(tx.heading_level(F.lit("ARTICLE 3 Scope"))) == 1
    assert one(tx.heading_level(F.lit("PURPOSE ........ 12"))) is None
    assert one(tx.hash_bucket(F.lit("abc"))) == int("a9993e364706816aba3e25717850c26c9cd0d89d", 16) % 100
    assert one(tx.labelled_date(F.lit("Revised: 12/2021"), "revised")) == "2021-12"
    assert one(tx.labelled_date(F.lit("Revised: 13/2021"), "revised")) is None
