"""The demo dossier at span level, end to end, against its known counts and ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimloom.functions import ids
from claimloom.operators import checkers, graph
from claimloom.plans import pipeline

CER, GSPR, STUDY, README = "doc_082f6fd5afc0df84", "doc_8c19005d83747c9a", "doc_faf32261b7e7f62a", "doc_10d06a9ffa9d19de"
# The texts and ids of the demo dossier.
HEADINGS = {0: "Clinical Evaluation Report - DemoDevice X100", 1: "1. Device Description", 3: "2. Clinical Performance", 6: "3. Benefit-Risk Conclusion", 8: "Appendix A - Endpoint Summary Table"}
BODY = {
    2: "DemoDevice X100 is a Class IIa active medical device intended for continuous non-invasive monitoring in adult patients.",
    4: "The pivotal study (Smith et al., 2023) reported a primary endpoint response rate of 87.4% (95% CI: 82.1-91.6) at 12 months in 412 patients.",
    5: "Adverse event rate was 3.2% across the safety population (n=412).",
    7: "Based on the available clinical evidence, the benefit-risk profile of DemoDevice X100 is considered acceptable for the intended use [1].",
}
TABLE = [["Endpoint", "Value", "Source"], ["Response rate at 12 months", "87.4%", "Smith 2023"], ["Adverse event rate", "3.2%", "Smith 2023"]]
SHEET = [
    ["GSPR_ID", "Requirement", "Applicable", "Evidence_Document", "Status"], ["GSPR-01", "Risk management process documented", "Yes", "CER.docx", "Met"], ["GSPR-02", "Clinical evaluation according to Annex XIV", "Yes", "CER.docx", "Met"],
    ["GSPR-03", "Post-market surveillance plan in place", "Yes", "PMS.docx", "Met"], ["GSPR-04", "Labeling complies with Annex I 23", "Yes", "Labeling.pdf", "Not Met"], ["GSPR-05", "Software lifecycle per IEC 62304", "Yes"],
]
PAGES = [
    "Smith J. et al. (2023). Pivotal study of DemoDevice X100. J Med Devices 12(3):201-215. Primary endpoint response rate: 87.4 percent at 12 months.",
    "Adverse events were reported in 3.2 percent of the n=412 cohort. Confidence interval 95 percent: 82.1 to 91.6.",
]
# End of the fixed values.


@pytest.fixture(scope="module")
def run(spark):
    spans, section = [], None
    for k in range(9):
        section = HEADINGS.get(k, section)
        spans.append((CER, "paragraph", k, None, section, HEADINGS.get(k) or BODY[k]))
    spans += [(CER, "table_cell", 3 * r + c, f"t0:r{r}:c{c}", HEADINGS[8], TABLE[r][c]) for r in range(3) for c in range(3)]
    k = 0
    for r, row in enumerate(SHEET, 1):
        for c, text in enumerate(row):
            spans.append((GSPR, "table_cell", k, f"GSPR:{'ABCDE'[c]}{r}", "GSPR:header" + (f":{'ABCDE'[c]}={SHEET[0][c]}" if r > 1 else ""), text))
            k += 1
    spans += [(STUDY, "page", n, None, None, text) for n, text in enumerate(PAGES, 1)]
    spans = spark.createDataFrame(spans, "document_id string, location_kind string, location_index int, location_label string, section string, text string")
    spans = spans.withColumn("span_id", ids.span_id(*(F.col(c) for c in ("document_id", "location_kind", "location_index", "location_label", "text"))))
    documents = [(CER, "CER", "CER.docx"), (GSPR, "GSPR_MAPPING", "GSPR_mapping.xlsx"), (STUDY, "SOURCE_PDF", "bibliography/source-study.pdf"), (README, "OTHER", "README.md")]
    documents = spark.createDataFrame([(*d, "0" * 64, "parser", []) for d in documents], "document_id string, kind string, path string, sha256 string, parser string, parse_warnings array<string>")
    return pipeline.run(documents, spans)


def test_counts(spark, run):
    counts = {name: df.count() for name, df in run.items()}
    assert counts == {"documents": 4, "spans": 48, "claims": 18, "citations": 5, "sources": 3, "evidence_links": 18, "findings": 7}
    assert {r.severity: r.n for r in checkers.by_severity(run["findings"]).collect() if r.n} == {"Major": 5, "Informational": 2}
    names = {"documents": "document", "spans": "span", "claims": "claim", "citations": "citation", "sources": "source", "evidence_links": "evidence_link", "findings": "finding"}
    records = graph.records({"audit_run": graph.audit_run(spark, "run_x", "/demo", counts)} | {names[k]: df for k, df in run.items()})
    assert records.count() == 104 and graph.unresolved_ids(run["findings"], records).count() == 0
    graph.check_language(run["findings"])


def test_ids_and_texts(run):
    spans = {r.text: r.span_id for r in run["spans"].where(F.col("document_id") != STUDY).collect()}
    assert spans[BODY[4]] == "span_d9abfffa43fb7cbf" and spans["Software lifecycle per IEC 62304"] == "span_d721352940869c5e"
    claims = {(r.span_id, r.claim_type, r.text) for r in run["claims"].collect()}
    assert {(spans[BODY[4]], "numeric", "87.4% (95% CI: 82.1-91.6)"), (spans[BODY[2]], "classification", "Class IIa active medical device"), (spans[BODY[5]], "numeric", "n=412")} <= claims
    links = {r.status: r.n for r in run["evidence_links"].groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert sum(links.values()) == 18 and links["resolved"] > 0 and links["source_missing"] == 1


def test_avoided_words_stop_the_reports(run):
    bad = run["findings"].limit(1).withColumn("evidence", F.lit("A regulatory failure."))
    with pytest.raises(ValueError, match="regulatory failure"):
        graph.check_language(bad)
