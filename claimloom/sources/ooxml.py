"""Workbooks and documents written with the standard library, equal bytes for equal rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

# The stamp of every archive entry, XML namespaces and the rows a sheet can hold.
STAMP = (1980, 1, 1, 0, 0, 0)
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_ROWS = 1_048_576
# End of the fixed values.

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def archive(entries: dict[str, str]) -> bytes:
    """A ZIP of ``entries`` in the order of their names, with one fixed stamp."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as file:
        for name in sorted(entries):
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type, info.create_system, info.external_attr = zipfile.ZIP_DEFLATED, 0, 0
            file.writestr(info, HEAD + entries[name])
    return out.getvalue()


def _text(value: object) -> str:
    return escape("".join(c for c in str(value) if c in "\t\n" or ord(c) >= 32))


def _package(main: str, kind: str, parts: list[tuple[str, str]]) -> dict[str, str]:
    types = "".join(f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for name, t in parts)
    return {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


def column(k: int) -> str:
    """The letters of column ``k``, counted from 1."""
    letters = ""
    while k:
        k, rest = divmod(k - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def workbook(sheets: dict[str, tuple[list[str], Iterable[Iterable[object]]]]) -> bytes:
    """A workbook with a header and rows per sheet; a sheet too long goes on in another."""
    entries, names = {}, []
    for title, (header, rows) in sheets.items():
        body: list[str] = []

        def close(body: list[str], title: str = title) -> None:
            names.append(title if title not in names else f"{title} {len(names) + 1}")
            entries[f"xl/worksheets/sheet{len(names)}.xml"] = f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(body)}</sheetData></worksheet>'
            body.clear()

        def put(row: Iterable[object], body: list[str] = body) -> None:
            n = len(body) + 1
            cells = "".join(f'<c r="{column(k)}{n}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{column(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{_text("" if v is None else v)}</t></is></c>' for k, v in enumerate(row, 1))
            body.append(f'<row r="{n}">{cells}</row>')

        put(header)
        for row in rows:
            if len(body) == SHEET_ROWS:
                close(body)
                put(header)
            put(row)
        close(body)
    listed = "".join(f'<sheet name="{_text(t)}" sheetId="{k}" r:id="rId{k}"/>' for k, t in enumerate(names, 1))
    entries["xl/workbook.xml"] = f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    entries["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>'
    parts = [("xl/workbook.xml", "spreadsheetml.sheet.main"), *((f"xl/worksheets/sheet{k}.xml", "spreadsheetml.worksheet") for k in range(1, len(names) + 1))]
    return archive(entries | _package("xl/workbook.xml", "workbook", parts))


def _paragraph(text: object, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{_text(text)}</w:t></w:r></w:p>'


def document(blocks: Iterable[tuple[str, object]]) -> bytes:
    """A document of blocks: ("h1" to "h6" or "p", text) and ("table", rows)."""
    body = []
    for kind, value in blocks:
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph('' if c is None else c)}</w:tc>" for c in row) + "</w:tr>" for row in value)
            body.append(f"<w:tbl><w:tblPr/><w:tblGrid/>{rows}</w:tbl>")
        else:
            body.append(_paragraph(value, "" if kind == "p" else f"Heading{kind[1]}"))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    entries = {
        "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{WORD}">{styles}</w:styles>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
    }
    parts = [("word/document.xml", "wordprocessingml.document.main"), ("word/styles.xml", "wordprocessingml.styles")]
    return archive(entries | _package("word/document.xml", "document", parts))
