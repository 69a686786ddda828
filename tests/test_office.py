"""Office files: round trips, broken archives, and archives that unpack to too much."""

import io
import zipfile

from pyspark.sql import functions as F

from scriptorium.sources import files, office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def packed(xml, name="word/document.xml"):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(name, xml)
    return data.getvalue()


def body(inner):
    return packed(f'<w:document xmlns:w="{W}"><w:body>{inner}</w:body></w:document>')


def test_runs_breaks_links_and_tables():
    inner = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>a&amp;é</w:t><w:noBreakHyphen/></w:r></w:p>"
    assert office.paragraphs(body(inner)) == ["a\tb\nlink", "", "a&é-"]
    assert office.paragraphs(packed(f'<w:document xmlns:w="{W}"/>')) == []


def test_texts_come_back_and_bad_files_are_marked(spark, tmp_path):
    bomb = packed(b"<a>" + b" " * 2_000_000 + b"</a>")
    bad = [b"", b"no zip", packed("<x/>", "other.xml"), packed("<broken"), packed('<!DOCTYPE d [<!ENTITY x "y">]><d>&x;</d>'), bomb, body("<w:p><w:r><w:t>fine</w:t></w:r></w:p>")[:-30]]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, None])], "i int, content binary")
    found = {r["i"]: r["x"] for r in rows.select("i", office.docx_text(F.col("content"), 1_000_000).alias("x")).collect()}
    assert found[7] is None and all(found[i].startswith("_Errore DOCX: ") for i in range(7)) and "more than" in found[5]
    texts = spark.createDataFrame([(0, "one\n\n two <&>\x07 é"), (1, ""), (2, None)], "i int, text string")
    back = texts.select("i", office.docx_text(office.docx_of(F.col("text"))).alias("x"))
    assert [r["x"] for r in back.orderBy("i").collect()] == ["one two <&> é", "", ""]
    for name, content in (("b/a.docx", body("<w:p><w:r><w:t>in a file</w:t></w:r></w:p>")), ("a-b/z.docx", b"broken"), ("a/c.md", b"plain")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    scanned = files.in_order(files.scan(spark, str(tmp_path)))
    assert [r["rel"] for r in scanned.select("rel").collect()] == ["a/c.md", "a-b/z.docx", "b/a.docx"]
    status = {r["rel"]: (r["text"], r["status"]) for r in files.texts(scanned).collect()}
    assert status["b/a.docx"] == ("in a file", "ok") and status["a-b/z.docx"][1] == "converter_error" and status["a/c.md"] == ("plain", "ok")
