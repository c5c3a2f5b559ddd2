"""Findings: what citations, links and sources leave open, as joins and filters.

Findings: eco_id, severity, checker_id, finding_type, affected_object_ids,
evidence, remediation_hint, adjudication_state. Findings are not deduplicated;
affected ids keep the order in which they are named, only the hash sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ids import eco_id
from claimloom.functions.text import quoted

# The words of the findings.
BROKEN = "checker.broken_citation_anchor:v1"
UNRESOLVED = "checker.unresolved_evidence_link:v1"
AVAILABILITY = "checker.source_availability_gap:v1"
MANUAL = "checker.manual_review_required:v1"
MAJOR, INFORMATIONAL, PENDING = "Major", "Informational", "pending"
SEVERITIES = ("Critical", "Major", "Minor", "Informational")
REVIEWED_TYPES = ("classification", "clinical_performance", "safety", "benefit_risk")
HINT = {
    "unresolved_citation_marker": "Add the cited source file to the dossier, add a numbered references list defining the marker, or replace the marker with an author-year citation that resolves to a local source.",
    "claim_with_ambiguous_sources": "Disambiguate the citation metadata or have a reviewer select the intended local source.",
    "claim_without_resolved_source": "Provide an inline citation that resolves to a local source, attach the supporting document, or queue the claim for manual review.",
    "completeness_gap_applicable_but_no_evidence": "Add the missing evidence document, or update the GSPR row to mark the requirement Not Applicable with a documented justification.",
    "classification_rationale_requires_manual_review": "Add a reference to the classification rationale (e.g., MDR Annex VIII rule applied, or a separate classification document), or accept the manual-review marker as a queue entry for the reviewer.",
    "evidence_link_requires_manual_review": "Have a reviewer inspect the claim against the available sources and adjudicate the evidence link manually.",
}
EVIDENCE = {
    "key": "Citation marker %s resolves to normalized key %s but no local source carries that citation_key.",
    "bracket": "Bracketed-numeric marker %s has no in-document references list and no bibliography source resolves it.",
    "ambiguous": "Claim %s of type %s matches multiple local sources; no single source was selected. Linking method: %s.",
    "unresolved": "Claim %s of type %s has no resolved local source. Linking method: %s.",
    "referenced": "Source %s is referenced by %d claim(s) but the file is not located in the provided dossier package.",
    "unreferenced": "Source %s is registered as missing_file but is not directly referenced by any extracted claim; review whether the reference can be removed or the file supplied.",
    "missing_hint": "Add %s to the dossier package, or update the referencing artifact to point at an available evidence file.",
    "gap": "Completeness gap on claim %s: the applicable GSPR row has no evidence document reference.",
    "class": "Classification claim %s requires manual review by RA: no inline rationale was detected and the linker could not deterministically resolve supporting evidence.",
    "manual": "Claim %s of type %s requires manual review: linker could not deterministically decide whether the claim is supported by any local source.",
}
# End of the fixed values.


def _finding(rows: DataFrame, token: str, severity: str, checker: str, kind: Column, affected: Column, evidence: Column, hint: Column) -> DataFrame:
    return rows.select(
        eco_id(token, affected).alias("eco_id"),
        F.lit(severity).alias("severity"),
        F.lit(checker).alias("checker_id"),
        kind.alias("finding_type"),
        affected.alias("affected_object_ids"),
        evidence.alias("evidence"),
        hint.alias("remediation_hint"),
        F.lit(PENDING).alias("adjudication_state"),
    )


def _hint(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in HINT.items() for x in pair]), kind)


def broken_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Mentions whose key no source carries, and bracketed numbers without a key; never footnotes."""
    keys = sources.select(F.col("citation_key").alias("normalized_key")).where("normalized_key <> ''").distinct()
    rows = citations.where("marker_form <> 'numeric_parenthetical'")
    keyed = rows.where("normalized_key is not null").join(keys, "normalized_key", "left_anti")
    keyed = keyed.withColumn("evidence", F.format_string(EVIDENCE["key"], quoted(F.col("marker_text")), quoted(F.col("normalized_key"))))
    bare = rows.where("marker_form = 'numeric_bracketed' and normalized_key is null")
    bare = bare.withColumn("evidence", F.format_string(EVIDENCE["bracket"], quoted(F.col("marker_text"))))
    columns = ["document_id", "span_id", "mention_id", "evidence"]
    kind = F.lit("unresolved_citation_marker")
    rows = keyed.select(columns).unionByName(bare.select(columns))
    return _finding(rows, "CITE", MAJOR, BROKEN, kind, F.array("document_id", "span_id", "mention_id"), F.col("evidence"), _hint(kind))


def _with_claims(links: DataFrame, claims: DataFrame) -> DataFrame:
    """``links`` with the claim of each; of claims with one id the first text in order."""
    claims = claims.groupBy("claim_id").agg(F.min(F.struct("text", "document_id", "span_id", "claim_type")).alias("c"))
    return links.join(claims.select("claim_id", "c.*"), "claim_id")


def unresolved_links(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Links without a source, or with several; one finding per link row."""
    rows = _with_claims(links.where(F.col("status").isin("source_unresolved", "source_ambiguous")), claims)
    several = F.col("status") == "source_ambiguous"
    kind = F.when(several, "claim_with_ambiguous_sources").otherwise("claim_without_resolved_source")
    parts = [quoted(F.col(c)) for c in ("claim_id", "claim_type", "linking_method")]
    evidence = F.when(several, F.format_string(EVIDENCE["ambiguous"], *parts)).otherwise(F.format_string(EVIDENCE["unresolved"], *parts))
    affected = F.concat(F.array("document_id", "span_id", "claim_id", "evidence_link_id"), F.array_sort("candidate_source_ids"))
    return _finding(rows, "SRC", MAJOR, UNRESOLVED, kind, affected, evidence, _hint(kind))


def availability_gaps(sources: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """Missing files with the claims that refer to them, and requirement rows without evidence."""
    missing = sources.where("availability_status = 'missing_file'")
    claimed = claims.select("claim_id", "document_id").dropDuplicates(["claim_id"])
    related = links.where("source_id is not null").select("source_id", "claim_id").join(claimed, "claim_id", "left")
    related = related.groupBy("source_id").agg(F.sort_array(F.collect_set("claim_id")).alias("claims"), F.sort_array(F.collect_set("document_id")).alias("docs"))
    none = F.array().cast("array<string>")
    rows = missing.join(related, "source_id", "left").withColumns({"claims": F.coalesce("claims", none), "docs": F.coalesce("docs", none)})
    name = quoted(F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise("(no path)"))
    evidence = F.when(F.size("claims") > 0, F.format_string(EVIDENCE["referenced"], name, F.size("claims"))).otherwise(F.format_string(EVIDENCE["unreferenced"], name))
    affected = F.concat("docs", F.array_sort(F.coalesce("origin_span_ids", none)), F.array("source_id"), "claims")
    files = _finding(rows, "COMPL", MAJOR, AVAILABILITY, F.lit("evidence_document_referenced_but_missing"), affected, evidence, F.format_string(EVIDENCE["missing_hint"], name))
    gaps = _with_claims(links.where("status = 'source_missing' and source_id is null").dropDuplicates(["evidence_link_id"]), claims)
    kind = F.lit("completeness_gap_applicable_but_no_evidence")
    gap_ids = F.array("document_id", "span_id", "claim_id", "evidence_link_id")
    return files.unionByName(_finding(gaps, "COMPL", MAJOR, AVAILABILITY, kind, gap_ids, F.format_string(EVIDENCE["gap"], quoted(F.col("claim_id"))), _hint(kind)))


def manual_reviews(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Links of substantive claims that only a reader can settle."""
    rows = _with_claims(links.where("status = 'manual_review_required'"), claims.where(F.col("claim_type").isin(*REVIEWED_TYPES)))
    classed = F.col("claim_type") == "classification"
    kind = F.when(classed, "classification_rationale_requires_manual_review").otherwise("evidence_link_requires_manual_review")
    evidence = F.when(classed, F.format_string(EVIDENCE["class"], quoted(F.col("text")))).otherwise(F.format_string(EVIDENCE["manual"], quoted(F.col("claim_id")), quoted(F.col("claim_type"))))
    return _finding(rows, "MANUAL", INFORMATIONAL, MANUAL, kind, F.array("document_id", "span_id", "claim_id", "evidence_link_id"), evidence, _hint(kind))


def findings(claims: DataFrame, citations: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """All four families; sort by eco_id at the sink."""
    found = broken_citations(citations, sources).unionByName(unresolved_links(links, claims))
    return found.unionByName(availability_gaps(sources, links, claims)).unionByName(manual_reviews(links, claims))


def by_severity(findings_: DataFrame) -> DataFrame:
    """Findings per severity, with zeros, in the fixed order of ``severity_pos``."""
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("severity_pos"), F.lit(s).alias("severity")) for k, s in enumerate(SEVERITIES)]))
    order = findings_.sparkSession.range(1).select(names.alias("x")).select("x.*")
    counts = findings_.groupBy("severity").agg(F.count("*").alias("n"))
    return order.join(counts, "severity", "left").select("severity_pos", "severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def by_type(findings_: DataFrame) -> DataFrame:
    return findings_.groupBy("finding_type").agg(F.count("*").alias("n"))
