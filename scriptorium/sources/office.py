"""Texts of packed office documents (.docx): a zip archive whose main part is XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import collapsed

#: Bytes of XML that a document may unpack to; a larger one is an error, so that no archive fills a worker's memory.
MOST_XML = 64 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MAIN = "word/document.xml"
#: What elements inside of a run stand for.
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
#: Code points that XML 1.0 has no way to write.
_UNWRITABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def _run_text(run: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else _MARKS.get(x.tag, "") for x in run)


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    """The text of a paragraph's own runs and of those in its links."""
    out = []
    for x in paragraph:
        if x.tag == f"{_W}r":
            out.append(_run_text(x))
        elif x.tag == f"{_W}hyperlink":
            out += [_run_text(r) for r in x if r.tag == f"{_W}r"]
    return "".join(out)


def paragraphs(content: bytes, most_xml: int = MOST_XML) -> list[str]:
    """The texts of the body's own paragraphs (tables aside); what isn't such a document raises ValueError."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(_MAIN) as part:
            xml = part.read(most_xml + 1)  # the archive's own word on the size isn't trusted
    except (KeyError, zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError, zipfile.zlib.error) as e:
        raise ValueError(f"not a document archive: {e}") from e
    if len(xml) > most_xml:
        raise ValueError(f"unpacks to more than {most_xml} bytes")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("declares entities")
    try:
        body = ElementTree.fromstring(xml).find(f"{_W}body")
    except ElementTree.ParseError as e:
        raise ValueError(f"broken XML: {e}") from e
    return [_paragraph_text(p) for p in body if p.tag == f"{_W}p"] if body is not None else []


def docx_text(content: Column, most_xml: int = MOST_XML) -> Column:
    """The collapsed text of a .docx file's bytes, its paragraphs as lines before; an error mark for what can't be read, null for null."""

    @F.arrow_udf(T.StringType())
    def read(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells:
            data = cell.as_py()
            try:
                out.append(None if data is None else "\n".join(p for p in paragraphs(data, most_xml) if p))
            except ValueError as e:
                out.append(f"_Errore DOCX: {e}_")
        return pa.array(out, pa.string())

    return collapsed(read(content))


def docx_of(text: Column) -> Column:
    """The bytes of a .docx file with one paragraph for each line of a text; what XML can't write is left out."""

    @F.arrow_udf(T.BinaryType())
    def packed(texts: pa.Array) -> pa.Array:
        out = []
        for cell in texts:
            body = ElementTree.Element(f"{_W}document")
            inner = ElementTree.SubElement(body, f"{_W}body")
            for line in (cell.as_py() or "").split("\n"):
                run = ElementTree.SubElement(ElementTree.SubElement(inner, f"{_W}p"), f"{_W}r")
                ElementTree.SubElement(run, f"{_W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = line
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
                archive.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
                archive.writestr(_MAIN, ElementTree.tostring(body, encoding="utf-8", xml_declaration=True))
            out.append(data.getvalue())
        return pa.array(out, pa.binary())

    return packed(F.regexp_replace(text, _UNWRITABLE, ""))
