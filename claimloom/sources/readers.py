"""Readers of DOCX, XLSX and PDF files as spans: dossier folders as typed DataFrames.

Files come in through Spark's binary source, one per row, and are parsed in
Arrow batches with the standard library. A file over ``MAX_BYTES`` is not read
but reported. PDF text is limited to plain and Flate streams of simple fonts;
pages without such text are reported as having no text layer.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import ids
from claimloom.operators.spans import inferred_kind, refined_kinds
from claimloom.sources.tables import written

# Names of parsers, warning codes and messages, and XML namespaces.
PARSERS = {".docx": "docx-xml", ".xlsx": "xlsx-xml", ".pdf": "pdf-streams"}
UNSUPPORTED, UNREADABLE = "unsupported-file", "unreadable-file"
MESSAGE = {
    "unsupported_file_type": "File extension is not supported; expected DOCX, PDF, or XLSX.",
    "empty_file": "Input file is empty.",
    "file_read_failed": "File is too large to be read in one row.",
    "extraction_unreadable_file": "File could not be opened",
    "extraction_no_text_layer": "PDF page has no extractable text layer (likely scanned/image-only).",
    "extraction_empty_document": "File opened cleanly but produced no content spans.",
    "extraction_formula_value_missing": "Formula cell has no cached value and was not evaluated during offline ingestion.",
}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# End of the fixed values.

MAX_BYTES = 1 << 30
Span = tuple[str, int, str | None, str | None, str]  # kind, index, label, section, text
Warning_ = tuple[str, str, str | None]  # code, message, location
WARNING = "struct<code:string,message:string,path:string,location:string>"
PARSED = f"path string, sha256 string, size bigint, spans array<struct<kind:string,index:int,label:string,section:string,text:string>>, warnings array<{WARNING}>"


def _warning(code: str, location: str | None = None, detail: str = "") -> Warning_:
    return code, MESSAGE[code] + detail, location


# --- DOCX ---


def _run_text(node: ElementTree.Element) -> str:
    signs = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    out = []
    for child in node:
        if child.tag == f"{W}t":
            out.append(child.text or "")
        elif child.tag in signs:
            out.append(signs[child.tag])
        elif child.tag in (f"{W}r", f"{W}hyperlink"):
            out.append(_run_text(child))
    return "".join(out)


def _cells(row: ElementTree.Element, above: list[str]) -> list[str]:
    """The texts of a row's cells by grid column; merged cells repeat theirs."""
    out: list[str] = []
    for cell in row.findall(f"{W}tc"):
        made = "\n".join(t for p in cell.findall(f"{W}p") if (t := _run_text(p).strip()))
        span = cell.find(f"{W}tcPr/{W}gridSpan")
        merge = cell.find(f"{W}tcPr/{W}vMerge")
        if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(out) < len(above):
            made = above[len(out)]
        out += [made] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
    return out


def read_docx(data: bytes) -> tuple[list[Span], list[Warning_]]:
    """Paragraphs and table cells in body order; headings 1 to 6 set the section of what follows."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{W}body")
        styles = ElementTree.fromstring(file.read("word/styles.xml")) if "word/styles.xml" in file.namelist() else None
    named = {}
    for style in styles.findall(f"{W}style") if styles is not None else ():
        name = style.find(f"{W}name")
        named[style.get(f"{W}styleId")] = name.get(f"{W}val", "") if name is not None else ""
    spans: list[Span] = []
    section, paragraphs, tables, cells = None, 0, 0, 0
    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            style = child.find(f"{W}pPr/{W}pStyle")
            style_id = style.get(f"{W}val", "") if style is not None else ""
            text = _run_text(child).strip()
            if text and re.fullmatch(r"heading [1-6]", named.get(style_id, style_id), re.I):
                section = text
            if text:
                spans.append(("paragraph", paragraphs, None, section, text))
            paragraphs += 1
        elif child.tag == f"{W}tbl":
            above: list[str] = []
            for r, row in enumerate(child.findall(f"{W}tr")):
                above = _cells(row, above)
                for c, text in enumerate(above):
                    if text:
                        spans.append(("table_cell", cells, f"t{tables}:r{r}:c{c}", section, text))
                        cells += 1
            tables += 1
    return spans, [] if spans else [_warning("extraction_empty_document")]


# --- XLSX ---


def _number_text(raw: str) -> str:
    value = float(raw)
    return str(int(value)) if value.is_integer() and "." not in raw and "e" not in raw.lower() else str(value)


def _cell_value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{X}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{X}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return value.text if kind in ("str", "e", "d") else _number_text(value.text)


def read_xlsx(data: bytes) -> tuple[list[Span], list[Warning_]]:
    """One span per cell with text, row by row; the first row names the columns in the section."""
    spans: list[Span] = []
    warnings: list[Warning_] = []
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        names = set(file.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in ElementTree.fromstring(file.read("xl/sharedStrings.xml")).findall(f"{X}si")]
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(file.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(file.read("xl/workbook.xml")).iter(f"{X}sheet"):
            title, target = sheet.get("name", ""), links.get(sheet.get(f"{R}id"), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                warnings.append(("extraction_partial_content", "Sheet could not be read", f"sheet={title}"))
                continue
            heads: dict[str, str] = {}
            for cell in ElementTree.fromstring(file.read(path)).iter(f"{X}c"):
                place = cell.get("r", "")
                column, row = re.fullmatch(r"([A-Z]+)(\d+)", place).groups()
                text = (_cell_value(cell, shared) or "").strip()
                if cell.find(f"{X}f") is not None and _cell_value(cell, shared) is None:
                    warnings.append(_warning("extraction_formula_value_missing", f"sheet={title};cell={place}"))
                if not text:
                    continue
                if row == "1":
                    heads[column] = text
                section = f"{title}:header" if row == "1" else f"{title}:header:{column}={heads[column]}" if column in heads else None
                spans.append(("table_cell", len(spans), f"{title}:{place}", section, text))
    return spans, warnings if spans else [*warnings, _warning("extraction_empty_document")]


# --- PDF ---

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"^(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()])*\]|-?[\d.]+|[A-Za-z'\"*]+", re.S)


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    body = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else plain.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return body.decode("utf-16-be", "replace") if body.startswith(b"\xfe\xff") else body.decode("cp1252", "replace")


def _pdf_text(content: bytes) -> str:
    """The strings shown by a content stream; a move to another line ends a line."""
    out, stack = [], []
    for token in SHOWN.findall(content):
        if token[:1] in b"([<-.0123456789":
            stack.append(token)
            continue
        if token in (b"Tj", b"'", b'"') and stack:
            out += ["\n"] * (token != b"Tj") + [_pdf_string(stack[-1])]
        elif token == b"TJ" and stack:
            out.append("".join(_pdf_string(s) for s in re.findall(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", stack[-1], re.S)))
        elif token in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]) or token in (b"T*", b"Tm", b"BT"):
            out.append("\n")
        stack = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def read_pdf(data: bytes) -> tuple[list[Span], list[Warning_]]:
    """One span per page with text, counted from 1."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}

    def stream(number: int) -> bytes:
        m = STREAM.match(objects.get(number, b""))
        if not m:
            return b""
        return zlib.decompress(m[2]) if b"FlateDecode" in m[1] else m[2] if b"/Filter" not in m[1] else b""

    for number in list(objects):
        if b"/ObjStm" in objects[number] and (m := re.search(rb"/First\s+(\d+)", objects[number])):
            body, first = stream(number), int(m[1])
            head = list(map(int, body[:first].split()))
            for k in range(0, len(head) - 1, 2):
                end = head[k + 3] if k + 3 < len(head) else len(body)
                objects.setdefault(head[k], body[first + head[k + 1] : first + end if k + 3 < len(head) else end])
    refs = lambda raw, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", raw) or [b"", b""])[1])]
    pages: list[int] = []

    def walk(number: int, seen: frozenset[int]) -> None:
        raw = objects.get(number, b"")
        if re.search(rb"/Type\s*/Pages\b", raw):
            for kid in refs(raw, b"Kids"):
                if kid not in seen:
                    walk(kid, seen | {kid})
        elif re.search(rb"/Type\s*/Page\b", raw):
            pages.append(number)

    for raw in objects.values():
        if re.search(rb"/Type\s*/Catalog\b", raw):
            for top in refs(raw, b"Pages"):
                walk(top, frozenset({top}))
    spans: list[Span] = []
    warnings: list[Warning_] = []
    for k, number in enumerate(pages, 1):
        try:
            text = "\n".join(filter(None, (_pdf_text(stream(c)) for c in refs(objects[number], b"Contents"))))
        except (zlib.error, ValueError) as error:
            warnings.append(("extraction_partial_content", f"Page {k} failed: {type(error).__name__}", f"page={k}"))
            continue
        if text:
            spans.append(("page", k, None, None, text))
        else:
            warnings.append(_warning("extraction_no_text_layer", f"page={k}"))
    if not spans and not any(w[0] == "extraction_no_text_layer" for w in warnings):
        warnings.append(_warning("extraction_empty_document"))
    return spans, warnings


READERS: dict[str, Callable[[bytes], tuple[list[Span], list[Warning_]]]] = {".docx": read_docx, ".xlsx": read_xlsx, ".pdf": read_pdf}


def parse(path: str, data: bytes | None, size: int) -> tuple[list[Span], list[Warning_]]:
    """Spans and warnings of one file, by its extension; nothing raises."""
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    if suffix not in READERS:
        return [], [_warning("unsupported_file_type"), *([_warning("empty_file")] if not size else [])]
    if not size:
        return [], [_warning("empty_file")]
    if data is None:
        return [], [_warning("file_read_failed")]
    try:
        return READERS[suffix](data)
    except Exception as error:  # any broken file is a warning, never a failed task
        return [], [_warning("extraction_unreadable_file", detail=f": {type(error).__name__}")]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for path, data, size, digest in zip(df["path"], df["content"], df["length"], df["sha256"]):
            spans, warnings = parse(path, data, size)
            spans = [dict(zip(("kind", "index", "label", "section", "text"), s)) for s in spans]
            warnings = [{"code": c, "message": m, "path": path, "location": loc} for c, m, loc in warnings]
            out.append((path, digest, size, spans, warnings))
        yield pd.DataFrame(out, columns=["path", "sha256", "size", "spans", "warnings"])


def load_dossier(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, warnings) of all files under ``folder``.

    Kinds follow the path, and for kind OTHER the title of a span. Files that
    cannot be read are documents with a warning and no spans.
    """
    base = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    place = F.element_at(F.split("path", base.removeprefix("file://").replace("\\", "\\\\"), 2), -1)
    content = F.when(F.col("length") <= MAX_BYTES, F.col("content"))
    rows = files.select(place.alias("path"), content.alias("content"), "length", F.sha2("content", 256).alias("sha256")).mapInPandas(_parsed, PARSED)
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    supported = suffix.isin(*READERS)
    codes = F.transform("warnings", lambda w: w["code"])
    unreadable = F.arrays_overlap(codes, F.array(F.lit("extraction_unreadable_file"), F.lit("empty_file"), F.lit("file_read_failed")))
    parser = F.when(~supported, UNSUPPORTED).when(unreadable, UNREADABLE)
    for end, name in PARSERS.items():
        parser = parser.when(suffix == end, name)
    metadata = F.create_map(F.lit("extension"), suffix, F.lit("ingestion_mode"), F.when(supported, "content_v1").otherwise("metadata_only"), F.lit("relative_path"), F.col("path"), F.lit("size_bytes"), F.col("size").cast("string"))
    rows = rows.withColumns({"kind": inferred_kind(F.col("path")), "parser": parser, "metadata": metadata})
    rows = written(rows.withColumn("document_id", ids.document_id(F.col("kind"), F.col("path"), F.col("sha256"))), "dossier-files")
    spans = rows.select("document_id", F.explode("spans").alias("s")).select("document_id", F.col("s.kind").alias("location_kind"), F.col("s.index").alias("location_index"), F.col("s.label").alias("location_label"), "s.section", "s.text")
    spans = spans.withColumn("span_id", ids.span_id(*(F.col(c) for c in ("document_id", "location_kind", "location_index", "location_label", "text"))))
    documents = rows.select("document_id", "kind", "path", "sha256", "parser", "metadata", F.col("warnings").alias("parse_warnings"))
    return refined_kinds(documents, spans), spans, rows.select("document_id", F.explode("warnings").alias("w")).select("document_id", "w.*")
