"""Predicates on spans: which are no evidence text, and what kind a document is.

Spans: span_id, document_id, location_kind, location_index, location_label,
section, text. Null texts are no noise and hold nothing to extract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import collapse, count_lines, holds, let, lines, rx, strip
from claimloom.sources.tables import small

# Patterns and word lists.
BIBLIOGRAPHY_SECTION = rx(r"\b(?:references?|bibliograph(?:y|ies)|sources)\b", True)
BIBLIOGRAPHY_PREFIX = rx(r"^\s*REF-\d+\.\s", True)
BIBLIOGRAPHY_TITLES = ("references", "reference list", "bibliography", "sources")
NUMBERED_REFERENCE = rx(r"^\s*\d{1,3}\.\s+[A-Z][A-Za-z'\-]+(?:\s+[A-Z]\.|\s+et\s+al\.?)[^\n]*?[.,;(\[–—]\s*(?:19|20)\d{2}\b", True)
CONTENTS_LINE = rx(r"^\s*(?:\d+(?:\.\d+)*\s+)?[A-Za-z][A-Za-z0-9 /,&()'\-]{2,}\s+\.{3,}\s*\d+\s*$")
NUMBERED_HEADING = rx(r"^\s*\d+(?:\.\d+)*\.?\s+[A-Za-z][A-Za-z0-9 /,&()'\-]{3,120}$")
PAGE_MARKER = rx(r"\b(?:page\s+)?\d+\s*(?:\(\s*\d+\s*\)|of\s+\d+)", True)
CHROME_WORD = rx(r"\b(?:document|rev\.?|revision)\b", True)
GUIDANCE_TERM = rx(r"\b(?:this\s+guidance|guidance\s+document|template)\b", True)
MODAL_TERM = rx(r"\b(?:shall|should|recommended)\b", True)
APPENDIX = rx(r"^\s*appendix\b", True)
PLACEHOLDER = rx(r"^\s*\[[^\]]*(?:insert|placeholder|to be completed)[^\]]*\]\s*$", True)
HEADERS = (
    rx(r"^Titel:[^\n]*\n(?:[^\n]*\n){0,4}Seite\s+\d+\s+von\s+\d+\s*\n", True),
    rx(r"^[^\n]{0,80}\n[^\n]*(?:Summary\s+of\s+Safety|SSCP)[^\n]*\n[^\n]+\n[^\n]*\bPage\s+\d+\s+of\s+\d+[^\n]*\n", True),
)
BOILERPLATE = rx(r"intended\s+to\s+provide\s+public\s+access|main\s+aspects\s+of\s+the\s+safety\s+and\s+clinical\s+performance", True)
CHART_TITLE = rx(r"Foreshortening\s+(?:Chart|Table)", True)
SHORTENING = rx(r"Percentage\s+Shortening", True)
MODEL_CODE = rx(r"\bCP\d{1,2}Z\d{2,3}\b")
PERCENTAGE = rx(r"\b\d+[.,]\d+\s*%")
SSCP_TITLE = "summary of safety and clinical performance"
SSCP_AFTER = (":", " -", " –", " —")
# End of the fixed values.



def _columns(*columns: Column | str) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def bibliography(text: Column | str = "text", section: Column | str = "section", kind: Column | str = "location_kind", found: Column | None = None) -> Column:
    """A reference list: by its section, its first words, its title, or two numbered entries of a page."""
    text, section, kind = _columns(text, section, kind)
    found = lines(text) if found is None else found
    title = F.regexp_replace(F.lower(F.get(found, F.lit(0))), ":+$", "")
    listed = (kind == "page") & (count_lines(found, NUMBERED_REFERENCE) >= 2)
    named = F.coalesce(section, F.lit("")).rlike(BIBLIOGRAPHY_SECTION)
    return F.coalesce(named | text.rlike(BIBLIOGRAPHY_PREFIX) | F.coalesce(title.isin(*BIBLIOGRAPHY_TITLES), F.lit(False)) | listed, named)


def contents(text: Column | str = "text", kind: Column | str = "location_kind", found: Column | None = None) -> Column:
    """A table of contents: titled with a leader line, or three leader lines of a page."""
    text, kind = _columns(text, kind)
    found = lines(text) if found is None else found
    leaders = count_lines(found, CONTENTS_LINE)
    titled = F.contains(F.lower(F.get(found, F.lit(0))), F.lit("table of contents"))
    return F.coalesce(holds(text, "...") & ((titled & (leaders >= 1)) | ((kind == "page") & (leaders >= 3))), F.lit(False))


def heading(text: Column | str = "text", section: Column | str = "section", kind: Column | str = "location_kind") -> Column:
    """A paragraph that is its section's title, or a page that is a short numbered heading."""
    text, section, kind = _columns(text, section, kind)
    title = (kind == "paragraph") & (strip(section) != "") & (F.left(strip(text), F.lit(1)) == F.left(strip(section), F.lit(1)))
    title = F.when(title, let(collapse(text), lambda flat: (flat != "") & (flat == collapse(section))))

    def numbered(flat: Column) -> Column:
        short = (F.length(flat) <= 140) & (F.size(F.split(flat, " ")) <= 12) & ~F.right(flat, F.lit(1)).isin(".", ";", ":")
        return short & flat.rlike(NUMBERED_HEADING)

    page = F.when((kind == "page") & section.isNull(), let(collapse(text), numbered))
    return F.coalesce(title, page, F.lit(False))


def chrome(text: Column | str = "text", kind: Column | str = "location_kind", found: Column | None = None) -> Column:
    """A page of one to four lines with a document word and a page marker."""
    text, kind = _columns(text, kind)
    found = lines(text) if found is None else found
    flat = F.array_join(found, " ")
    return F.coalesce((kind == "page") & F.size(found).between(1, 4) & flat.rlike(CHROME_WORD) & flat.rlike(PAGE_MARKER), F.lit(False))


def appendix(text: Column | str = "text", found: Column | None = None) -> Column:
    """An appendix whose lines are placeholders."""
    (text,) = _columns(text)
    found = lines(text) if found is None else found
    rest = F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
    return F.coalesce(F.get(found, F.lit(0)).rlike(APPENDIX) & (count_lines(rest, PLACEHOLDER) >= 2), F.lit(False))


def guidance(text: Column | str = "text", document_kind: Column | None = None) -> Column:
    """Guidance or template prose, in documents of kind OTHER or unknown."""
    (text,) = _columns(text)
    other = F.lit(True) if document_kind is None else F.coalesce(document_kind == "OTHER", F.lit(True))
    said = F.when(other & holds(F.lower(text), "guidance", "template"), let(collapse(text), lambda flat: flat.rlike(GUIDANCE_TERM) & flat.rlike(MODAL_TERM)))
    return F.coalesce(said, F.lit(False))


def citation_noise() -> Column:
    """Whether a span gives no citations; its lines are split once."""
    return let(lines(F.col("text")), lambda found: bibliography(found=found) | contents(found=found) | heading() | chrome(found=found) | appendix(found=found))


def without_header(text: Column) -> Column:
    """``text`` without a running page header of one of two shapes at its start."""
    return F.when(text.rlike(HEADERS[0]), F.regexp_replace(text, HEADERS[0], "")).otherwise(F.regexp_replace(text, HEADERS[1], ""))


def sizing_table(text: Column | str = "text") -> Column:
    """A table of sizes, whose percentages are no claims."""
    (text,) = _columns(text)
    codes = F.regexp_count(text, F.lit(MODEL_CODE))
    many = (codes >= 2) & (F.size(lines(text)) >= 4) & (F.regexp_count(text, F.lit(PERCENTAGE)) >= 2)
    coded = F.when(holds(text, "CP"), (text.rlike(SHORTENING) & (codes >= 1)) | many).otherwise(False)
    return F.coalesce((holds(F.lower(text), "foreshortening") & text.rlike(CHART_TITLE)) | coded, F.lit(False))


def classified(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """``spans`` with document_kind, reasons, suppress_claims, citation_noise and retain_as_anchor."""
    kinds = documents.select("document_id", F.col("kind").alias("document_kind")).dropDuplicates(["document_id"])
    spans = spans.join(small(kinds, 500_000), "document_id", "left")

    def reasons_of(found: Column) -> Column:
        tests = {
            "bibliography": bibliography(found=found),
            "table_of_contents": contents(found=found),
            "heading": heading(),
            "pdf_chrome": chrome(found=found),
            "appendix_template": appendix(found=found),
            "guidance_meta": guidance(document_kind=F.col("document_kind")),
        }
        return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))

    reasons = let(lines(F.col("text")), reasons_of)
    spans = spans.withColumn("reasons", reasons)
    return spans.withColumns(
        {
            "suppress_claims": F.size("reasons") > 0,
            "citation_noise": F.size(F.array_except("reasons", F.array(F.lit("guidance_meta")))) > 0,
            "retain_as_anchor": F.arrays_overlap("reasons", F.array(F.lit("bibliography"), F.lit("guidance_meta"))),
        }
    )


def inferred_kind(path: Column) -> Column:
    """The kind of a document from the words of its path."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.lower(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))
    stem = F.translate(stem, "- ", "__")
    tokens = F.split(stem, "_")
    has = lambda word: F.array_contains(tokens, word)
    whole = F.lower(path)
    return (
        F.when(F.contains(stem, F.lit("gspr")), "GSPR_MAPPING")
        .when(has("evidence") | F.contains(stem, F.lit("evidence_table")), "EVIDENCE_TABLE")
        .when(has("pmcf"), "PMCF")
        .when(has("psur"), "PSUR")
        .when(has("pms"), "PMS")
        .when(has("sscp"), "SSCP")
        .when(has("cer") | F.contains(stem, F.lit("clinical_evaluation")), "CER")
        .when(F.endswith(whole, F.lit(".pdf")) & (F.contains(whole, F.lit("bibliography/")) | F.contains(whole, F.lit("sources/"))), "SOURCE_PDF")
        .otherwise("OTHER")
    )


def refined_kinds(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` where kind OTHER becomes SSCP if a span is the title of such a summary."""
    flat = F.lower(collapse(F.col("text")))
    title = flat == SSCP_TITLE
    for sign in SSCP_AFTER:
        title = title | F.startswith(flat, F.lit(SSCP_TITLE + sign))
    titled = spans.where(title).select("document_id").distinct().withColumn("titled", F.lit(True))
    documents = documents.join(titled, "document_id", "left")
    return documents.withColumn("kind", F.when((F.col("kind") == "OTHER") & F.col("titled"), "SSCP").otherwise(F.col("kind"))).drop("titled")
