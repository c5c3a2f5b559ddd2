"""The whole run over a folder of documents: read, extract, link, check, write.

``python -m claimloom.plans.pipeline DOSSIER --out RUN``
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators import checkers, citations, claims, graph, review, sources
from claimloom.sources import sinks
from claimloom.sources.readers import load_dossier
from claimloom.sources.tables import written


def run(documents: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """All artifacts of ``documents`` and ``spans``; those with several readers are written once."""
    made = written(claims.claims(spans, documents), "claims")
    cited = written(citations.mentions(spans), "citations")
    found = written(sources.sources(documents, spans), "sources")
    linked = written(sources.links(made, cited, found, spans), "links")
    findings = written(checkers.findings(made, cited, found, linked), "findings")
    return {"documents": documents, "spans": spans, "claims": made, "citations": cited, "sources": found, "evidence_links": linked, "findings": findings}


def verify(spark: SparkSession, dossier: str, output: str, pack: str | None = None) -> dict[str, int]:
    """Runs over ``dossier`` and writes to ``output``; the rows per artifact.

    Both are folders of this machine, or of one that all machines of the cluster
    see under the same path. ``pack`` is the folder of a rule pack; with it a run
    over SSCP documents also writes the review list.
    """
    sinks.check_output(dossier, output)
    documents, spans, _ = load_dossier(spark, f"file://{Path(dossier).resolve()}")
    if spans.limit(1).count() == 0:
        raise ValueError("no document gave any span")
    artifacts = run(documents, spans)
    graph.check_language(artifacts["findings"])
    sinks.clear_output(output)
    counts = sinks.write_package(artifacts, f"file://{Path(output).resolve()}")
    counts["graph_records"] = 1 + sum(counts.values())
    run_id = graph.run_id(documents, counts)
    names = {"documents": "document", "spans": "span", "claims": "claim", "citations": "citation", "sources": "source", "evidence_links": "evidence_link", "findings": "finding"}
    place = Path(dossier).resolve().as_posix()
    records = graph.records({"audit_run": graph.audit_run(spark, run_id, place, counts)} | {names[k]: df for k, df in artifacts.items()})
    hashes = {"graph.jsonl": sinks.write_jsonl(records, f"{output}/graph.jsonl", "family_pos", "record_id", "record"), "findings.csv": sinks.write_findings_csv(artifacts["findings"], f"{output}/findings.csv")}
    reports = sinks.write_reports(artifacts, counts, run_id, output, place, hashes)
    if pack and documents.where("kind = 'SSCP'").limit(1).count():
        at = f"file://{Path(pack).resolve()}"
        rules, texts = review.rules_of(spark, at), review.source_texts(review.sources_of(spark, at), review.texts_of(spark, at))
        items = review.review_items(rules, review.evaluations(rules, spans, documents, texts.where("text is not null")), run_id)
        reports |= sinks.write_review(items, json.loads(Path(pack, "rules.json").read_text(encoding="utf-8")), review.run_reference({"run_id": run_id, "artifact_counts": counts}), output)
    fixed = {"manifest_schema_version": "audit.v1", "run_id": run_id, "artifact_hashes": dict(sorted((hashes | reports).items())), "artifact_counts": dict(sorted(counts.items())), "known_limitations": list(sinks.LIMITATIONS)} | sinks.methods(artifacts)
    lost = graph.unresolved_ids(artifacts["findings"], records).orderBy("record_id")
    sinks.write_json(Path(output, "manifest.json"), fixed, {"input_documents": (r.asDict(recursive=True) for r in sinks.described(documents).toLocalIterator()), "unresolved_affected_ids": (r[0] for r in lost.toLocalIterator())})
    return counts


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimloom")
    parser.add_argument("dossier")
    parser.add_argument("--out", required=True)
    parser.add_argument("--pack")
    asked = parser.parse_args(args)
    if not Path(asked.dossier).is_dir():
        print(f"no folder {asked.dossier}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("claimloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(verify(spark, asked.dossier, asked.out, asked.pack), sort_keys=True))
        print(*sinks.listing(asked.out), sep="\n")
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
