"""Sinks: JSON lines, CSV of findings, and a package of all artifacts with hashes.

``write_package`` writes at scale, one folder per artifact. ``write_jsonl`` and
``write_findings_csv`` write single files with fixed bytes; they stream rows in
order through the driver and never hold them all.
"""

from __future__ import annotations

import csv
import hashlib
import json
import shutil
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import checkers, review
from claimloom.operators.graph import check_language, sorted_warnings
from claimloom.sources import ooxml

# Columns of the findings file and names of the artifacts.
FINDING_COLUMNS = ("eco_id", "severity", "checker_id", "finding_type", "affected_object_ids", "evidence", "remediation_hint", "adjudication_state")
ARTIFACTS = ("documents", "spans", "claims", "citations", "sources", "evidence_links", "findings", "graph")
FILES = ("manifest.json", "findings.csv", "graph.jsonl", "report.json", "findings.xlsx", "report.docx", "guidance_review.json", "guidance_review.md")
LIMITATIONS = (
    "numeric mismatch checker not yet implemented",
    "cross-document contradiction checker not yet implemented",
    "GSPR Status-aware severity refinement not yet implemented",
    "bibliography-to-sources resolver for in-document footnotes remains NEEDS-DESIGN",
    "no graph database server; graph persistence is graph.jsonl only",
    "no cryptographic proof layer (Merkle / DSSE / Sigstore / in-toto deferred)",
)
# End of the fixed values.

NEXT_STEPS = ("Settle each finding and note the result beside it.", "Supply the files of sources that are missing.", "Run again; equal inputs give equal ids.")


def write_jsonl(df: DataFrame, path: str, *order: str) -> str:
    """``df`` as one JSON object per line, sorted by ``order``; the SHA-256 of the file. Nulls stay; the file always exists."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    digest = hashlib.sha256()
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
            line = json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n"
            out.write(line)
            digest.update(line.encode())
    return digest.hexdigest()


def write_findings_csv(findings: DataFrame, path: str) -> str:
    """Findings sorted by id, their affected ids joined with ``;``; the SHA-256 of the file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = findings.withColumn("affected_object_ids", F.concat_ws(";", "affected_object_ids")).select(*FINDING_COLUMNS)
    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, quoting=csv.QUOTE_MINIMAL)
        writer.writerow(FINDING_COLUMNS)
        for row in rows.orderBy("eco_id", "affected_object_ids").toLocalIterator():
            writer.writerow(row)
    with open(path, "rb") as written:
        return hashlib.file_digest(written, "sha256").hexdigest()


def check_output(source: str, output: str) -> None:
    """Raises if one of the two folders lies within the other."""
    a, b = Path(source).resolve(), Path(output).resolve()
    if a == b or a in b.parents or b in a.parents:
        raise ValueError(f"output {output} and input {source} overlap")


def clear_output(output: str) -> None:
    """Removes the artifacts of an earlier run, by their names, and nothing else."""
    for name in (*ARTIFACTS, *FILES):
        path = Path(output) / name
        if path.is_symlink() or path.is_file():
            path.unlink()
        elif path.is_dir():
            shutil.rmtree(path)


def write_package(artifacts: dict[str, DataFrame], output: str) -> dict[str, int]:
    """Each of ``artifacts`` as a folder of JSON lines under ``output``; the rows of each."""
    for name, df in artifacts.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{output}/{name}")
    spark = next(iter(artifacts.values())).sparkSession
    return {name: spark.read.schema(df.schema).json(f"{output}/{name}").count() for name, df in artifacts.items()}


def write_json(path: Path, fixed: dict, streamed: dict[str, Iterable]) -> str:
    """An object with sorted keys, as ``json.dumps`` with an indent of two would write it; the lists of ``streamed`` are never held whole. The SHA-256 of the file."""
    digest = hashlib.sha256()
    with open(path, "wb") as out:

        def put(text: str) -> None:
            out.write(text.encode())
            digest.update(text.encode())

        shown = lambda value, depth: json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str).replace("\n", "\n" + "  " * depth)
        for k, key in enumerate(sorted({*fixed, *streamed})):
            put(("{\n  " if not k else ",\n  ") + json.dumps(key) + ": ")
            if key in fixed:
                put(shown(fixed[key], 1))
                continue
            some = False
            for value in streamed[key]:
                put((",\n    " if some else "[\n    ") + shown(value, 2))
                some = True
            put("\n  ]" if some else "[]")
        put("\n}\n")
    return digest.hexdigest()


def described(documents: DataFrame) -> DataFrame:
    """The documents in the order of their ids, with their warnings in a fixed order."""
    rows = documents.withColumn("parse_warnings", sorted_warnings("parse_warnings") if dict(documents.dtypes)["parse_warnings"].startswith("array<struct") else F.array_sort("parse_warnings"))
    codes = F.array_sort(F.array_distinct(F.transform("parse_warnings", lambda w: w["code"]))) if dict(rows.dtypes)["parse_warnings"].startswith("array<struct") else F.col("parse_warnings")
    return rows.select("document_id", "path", "kind", "sha256", "parser", codes.alias("parse_warning_codes"), "parse_warnings").orderBy("document_id")


def _rows(df: DataFrame) -> Iterator[dict]:
    return (row.asDict(recursive=True) for row in df.toLocalIterator())


def methods(artifacts: dict[str, DataFrame]) -> dict[str, list[str]]:
    names = lambda df, c: [r[0] for r in df.select(c).distinct().orderBy(c).collect()]
    return {"extraction_methods": names(artifacts["claims"], "extraction_method"), "checker_ids": names(artifacts["findings"], "checker_id"), "linking_methods": names(artifacts["evidence_links"], "linking_method")}


def write_reports(artifacts: dict[str, DataFrame], counts: dict[str, int], run_id: str, output: str, dossier: str, hashes: dict[str, str]) -> dict[str, str]:
    """report.json, findings.xlsx and report.docx of a run, and the SHA-256 of each.

    Findings are streamed in the order of their ids; the files hold all of them.
    ``hashes`` are those of the artifacts reported on.
    """
    findings, documents, found = artifacts["findings"], described(artifacts["documents"]), artifacts["sources"]
    check_language(findings)
    severities = [(r.severity, r.n) for r in checkers.by_severity(findings).orderBy("severity_pos").collect()]
    types = [(r.finding_type, r.n) for r in checkers.by_type(findings).orderBy("finding_type").collect()]
    observed = methods(artifacts)
    ordered = findings.select(*FINDING_COLUMNS).orderBy("eco_id", F.concat_ws(";", "affected_object_ids"))
    report = {
        "report_schema_version": "report.v1", "run_id": run_id, "dossier_path": dossier, "artifact_counts": dict(sorted(counts.items())), "known_limitations": list(LIMITATIONS), "source_artifact_hashes": dict(sorted(hashes.items())),
        "findings_summary": {"by_severity": dict(severities), "by_finding_type": dict(types)}, "observed_methods": observed,
    }
    done = {"report.json": write_json(Path(output, "report.json"), report, {"input_documents": _rows(documents), "findings_detail": _rows(ordered)})}
    flat = ordered.withColumn("affected_object_ids", F.concat_ws(";", "affected_object_ids"))
    summary = [("by_severity", *x) for x in severities] + [("by_finding_type", *x) for x in types]
    review = ["reviewer", "review_notes", "resolution"]
    book = ooxml.workbook({"Findings": ([*FINDING_COLUMNS, *review], ((*r, "", "", "") for r in flat.toLocalIterator())), "Summary": (["Section", "Key", "Count"], summary)})
    listed = documents.select("document_id", "kind", "path", "sha256", "parser", F.array_join("parse_warning_codes", ", "))
    local = found.select("source_id", "path", "citation_key", "availability_status").orderBy("source_id")
    page = ooxml.document(
        [
            ("h1", "Evidence report"), ("p", f"Dossier: {dossier}"), ("p", f"Run ID: {run_id}"), ("h1", "Run summary"), ("table", [("Artifact count", "Value"), *sorted(counts.items())]),
            ("h1", "Input documents"), ("table", [("document_id", "kind", "path", "sha256", "parser", "warnings"), *listed.toLocalIterator()]), ("h2", "Sources"), ("table", [("source_id", "path", "citation_key", "status"), *local.toLocalIterator()]),
            ("h1", "Artifact inventory"), ("table", [("Artifact", "SHA-256"), *sorted(hashes.items())]),
            ("h1", "Findings summary"), ("h2", "By severity"), ("table", [("Severity", "Count"), *severities]), ("h2", "By finding type"), ("table", [("Finding type", "Count"), *types]),
            ("h1", "Finding detail"), ("table", [FINDING_COLUMNS, *flat.toLocalIterator()]), ("h1", "Known limitations"), *(("p", x) for x in LIMITATIONS),
            ("h1", "Audit and provenance summary"), *(("p", f"{name}: {', '.join(x)}") for name, x in observed.items()), ("h1", "Reviewer next steps"), *(("p", x) for x in NEXT_STEPS),
        ]
    )
    for name, data in {"findings.xlsx": book, "report.docx": page}.items():
        Path(output, name).write_bytes(data)
        done[name] = hashlib.sha256(data).hexdigest()
    return done


def write_review(items: DataFrame, pack: dict, run: dict | None, output: str) -> dict[str, str]:
    """guidance_review.json and guidance_review.md, and the SHA-256 of each; ``items`` as ``review.review_items`` gives."""
    items = items.orderBy("pos")
    n = items.count()
    head = {"_schema_version": review.SCHEMA, **{k: pack.get(k) for k in ("document_family", "pack_id", "pack_version", "pack_status")}, "n_review_items": n, "output_boundary": review.BOUNDARY, "review_status_default": review.TO_CONFIRM, "run_reference": run}
    shown = ({k: v for k, v in x.items() if k != "pos"} for x in _rows(items))
    done = {"guidance_review.json": write_json(Path(output, "guidance_review.json"), head, {"review_items": shown})}
    digest = hashlib.sha256()
    with open(Path(output, "guidance_review.md"), "wb") as out:
        for line in review.markdown(_rows(items), pack, n, run):
            out.write(data := f"{line}\n".encode())
            digest.update(data)
    return done | {"guidance_review.md": digest.hexdigest()}


def listing(output: str) -> list[str]:
    """A line for each artifact a run may leave in ``output``, with its size or absence."""
    names = [*ARTIFACTS[:-1], *FILES]
    return [f"{name}: {'missing' if not (p := Path(output) / name).exists() else 'folder' if p.is_dir() else f'{p.stat().st_size} bytes'}" for name in names]
