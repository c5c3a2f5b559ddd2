from __future__ import annotations

import io
import hashlib
import json
import zipfile
import zlib

import pytest

from claimloom.plans import pipeline
from claimloom.sources import readers, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def docx(*blocks):
    def p(text, style=None):
        return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'

    body = "".join(p(*b) if isinstance(b, tuple) else b for b in blocks)
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return zipped(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word__styles.xml": styles})


def xlsx(rows, name="GSPR"):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{r}">{v[0]}</c>' for c, v in row.items()) + "</row>" for r, row in rows.items())
    return zipped(**{
        "xl__workbook.xml": f'<workbook {S}><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl__worksheets__sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>",
    })


def pdf(*pages, flate=True):
    out, n = [b"%PDF-1.4\n"], 3
    kids, bodies = [], []
    for lines in pages:
        text = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + x.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET" if lines else b""
        body = zlib.compress(text) if flate else text
        bodies.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (n, n + 1))
        bodies.append(b"%d 0 obj\n<< /Length %d %s>>\nstream\n" % (n + 1, len(body), b"/Filter /FlateDecode " if flate else b"") + body + b"\nendstream\nendobj\n")
        kids.append(b"%d 0 R" % n)
        n += 2
    out.append(b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>\nendobj\n" % len(kids))
    return b"".join(out + bodies) + b"%%EOF"


DOCX = docx(("Scope", "H1"), ("",), ("Leaks fell by 3.2% (Kerry, 2022).",), f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>Both</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>n=412</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'.replace("{W}", ""))
XLSX = xlsx({1: {"A": "Id", "B": "Requirement", "C": "Applicable", "D": "Evidence_Document"}, 2: {"A": ("<v>1</v>",), "B": "Need", "C": "Yes", "D": "PMS.docx"}, 3: {"A": ("<v>2.50</v>",), "B": "Gap", "C": "yes", "F": "lone", "G": ("<f>A1</f>",)}})


def test_docx():
    spans, warnings = readers.read_docx(DOCX)
    assert spans == [("paragraph", 0, None, "Scope", "Scope"), ("paragraph", 2, None, "Scope", "Leaks fell by 3.2% (Kerry, 2022)."), ("table_cell", 0, "t0:r0:c0", "Scope", "Both"), ("table_cell", 1, "t0:r0:c1", "Scope", "Both"), ("table_cell", 2, "t0:r1:c1", "Scope", "n=412\nx")]
    assert warnings == [] and readers.read_docx(docx())[1][0][0] == "extraction_empty_document"


def test_xlsx():
    spans, warnings = readers.read_xlsx(XLSX)
    assert [s[2:] for s in spans][4:] == [("GSPR:A2", "GSPR:header:A=Id", "1"), ("GSPR:B2", "GSPR:header:B=Requirement", "Need"), ("GSPR:C2", "GSPR:header:C=Applicable", "Yes"), ("GSPR:D2", "GSPR:header:D=Evidence_Document", "PMS.docx"), ("GSPR:A3", "GSPR:header:A=Id", "2.5"), ("GSPR:B3", "GSPR:header:B=Requirement", "Gap"), ("GSPR:C3", "GSPR:header:C=Applicable", "yes"), ("GSPR:F3", None, "lone")]
    assert [s[1] for s in spans] == list(range(12)) and warnings[0][0] == "extraction_formula_value_missing" and warnings[0][2] == "sheet=GSPR;cell=G3"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf(flate):
    spans, warnings = readers.read_pdf(pdf(["Kerry J. 2022", "Second (line)"], [], ["Page three"], flate=flate))
    assert spans == [("page", 1, None, None, "Kerry J. 2022\nSecond (line)"), ("page", 3, None, None, "Page three")] and [w[0] for w in warnings] == ["extraction_no_text_layer"]


@pytest.mark.parametrize("path, data, code", [("a.docx", b"junk", "extraction_unreadable_file"), ("a.pdf", b"junk", "extraction_unreadable_file"), ("a.xlsx", b"", "empty_file"), ("a.txt", b"x", "unsupported_file_type"), ("noend", b"", "empty_file"), ("big.pdf", None, "file_read_failed")])
def test_broken_files_are_warnings(path, data, code):
    spans, warnings = readers.parse(path, data, len(data) if data is not None else 5)
    assert spans == [] and code in [w[0] for w in warnings]


def test_dossier_to_package(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "bibliography").mkdir(parents=True)
    for name, data in {"CER.docx": DOCX, "GSPR_mapping.xlsx": XLSX, "bibliography/a.pdf": pdf(["Kerry J. 2022 Title"]), "README.md": b"text"}.items():
        (source / name).write_bytes(data)
    counts = pipeline.verify(spark, str(source), str(out))
    assert counts["documents"] == 4 and counts["spans"] == 5 + 12 + 1 and counts["sources"] == 2
    findings = [json.loads(x) for f in (out / "findings").glob("*.json") for x in f.read_text().splitlines()]
    assert {f["finding_type"] for f in findings} == {"evidence_document_referenced_but_missing", "completeness_gap_applicable_but_no_evidence"}
    graph = (out / "graph.jsonl").read_bytes()
    (out / "kept.txt").write_text("mine")
    first = (out / "manifest.json").read_bytes()
    pipeline.verify(spark, str(source), str(out))
    assert (out / "graph.jsonl").read_bytes() == graph and (out / "manifest.json").read_bytes() == first and (out / "kept.txt").exists()
    manifest, report = json.loads(first), json.loads((out / "report.json").read_text())
    assert sorted(manifest) == sorted(["manifest_schema_version", "run_id", "input_documents", "artifact_hashes", "artifact_counts", "extraction_methods", "checker_ids", "linking_methods", "unresolved_affected_ids", "known_limitations"])
    assert manifest["unresolved_affected_ids"] == [] and manifest["artifact_counts"] == counts and counts["graph_records"] == graph.count(b"\n") == 1 + sum(n for k, n in counts.items() if k != "graph_records")
    assert all(hashlib.sha256((out / name).read_bytes()).hexdigest() == digest for name, digest in manifest["artifact_hashes"].items()) and set(manifest["artifact_hashes"]) == {"graph.jsonl", "findings.csv", "report.json", "findings.xlsx", "report.docx"}
    assert first == (json.dumps(manifest, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()
    assert json.loads(graph.split(b"\n")[0])["record"].startswith('{"record_type":"audit_run"') and len(report["findings_detail"]) == counts["findings"] and [d["document_id"] for d in report["input_documents"]] == sorted(d["document_id"] for d in manifest["input_documents"])
    readme = next(d for d in manifest["input_documents"] if d["path"] == "README.md")
    assert readme["sha256"] == hashlib.sha256(b"text").hexdigest() and readme["parse_warning_codes"] == ["unsupported_file_type"]
    assert "manifest.json: missing" not in sinks.listing(str(out)) and "guidance_review.md: missing" in sinks.listing(str(out))
    with pytest.raises(ValueError):
        sinks.check_output(str(source), str(source / "x"))
    assert pipeline.main([str(tmp_path / "none"), "--out", str(out)]) == 2


def test_stream(spark, sf_dir, tmp_path):
    from claimloom.plans.queries import spans_of
    from claimloom.operators.citations import mentions
    from claimloom.streaming.mentions import mention_stream

    folder = tmp_path / "spans"
    spark.read.parquet(f"{sf_dir}/spans.parquet").write.parquet(str(folder))
    query = mention_stream(spark, str(folder), "5000 days").writeStream.format("memory").queryName("mentions_now").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = sorted(r.mention_id for r in spark.table("mentions_now").collect())
    assert found == sorted(r.mention_id for r in mentions(spans_of(spark, sf_dir)).collect())
