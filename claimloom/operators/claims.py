"""Claim candidates in spans: numbers, measured values, entities, windows, gaps.

Everything that concerns one span is found in its row; requirement rows are
joined on (document_id, row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ids import claim_id
from claimloom.functions.text import blocked, find_all, holds, let, normalised, occurrences, rx, strip
from claimloom.operators import spans as noise
from claimloom.operators.citations import mentions_of

# Patterns, windows, value lists and method names.
CI = r"(?:95|90|99)\s*%?\s*CI\s*[:\-]\s*[\d.,\s\-]+"
PERCENT_CI = rx(rf"(?<!\d)(\d{{1,3}}\.\d+\s*%)\s*(\({CI}\))")
PERCENT = rx(r"(?<!\d)\d{1,3}\.\d+\s*%")
PERCENT_WORD = rx(r"(?<!\d)\d{1,3}\.\d+\s+percent(?:[^.()\[\]]{0,40})?", True)
CI_RANGE = rx(CI)
COUNT = rx(r"n\s*=\s*\d+")
NUMBER = r"[+-]?\d+(?:[.,]\d+)?"
UNITS = r"(?:mmHg|atm|gauss/cm|W/kg|°C|days?|years?)"
RANGE = rx(rf"{NUMBER}\s+to\s+{NUMBER}\s*{UNITS}\b", True)
MEAN_SD = rx(rf"{NUMBER}\s*[±]\s*{NUMBER}\s*{UNITS}\b", True)
DRIFT = rx(rf"{NUMBER}\s*mmHg\s+(?:drift\s+)?in\s+{NUMBER}\s*(?:h|hours?|days?)\b", True)
WORDED = rx(rf"(?:up\s+to|maximum\s+of|at\s+least|no\s+more\s+than|less\s+than)\s+{NUMBER}\s*{UNITS}\b", True)
SIGNED = rx(rf"(?:≥|≤|>=|<=|>|<)\s*{NUMBER}\s*{UNITS}\b", True)
SINGLE = rx(rf"(?<![A-Za-z\d/]){NUMBER}\s*{UNITS}\b", True)
TESLA = rx(rf"{NUMBER}\s+T\b(?=[,.\s\n)\]]|$)")
BURST = rx(r"RBP\s*=\s*\d+\.\d+")
IMAGING = rx(r"magnetic\s+field|static|tesla|mri|MR\s+system|MR\s+conditional", True)
IMAGING_WINDOW, BURST_WINDOW, PERFORMANCE_WINDOW = 200, 500, 120
BURST_MARK = "(atm)"
CLASSES = (
    rx(r"Class\s+II[ab]?\s+(?:[\w-]+\s+){0,4}medical\s+device", True),
    rx(r"Class\s+III\s+(?:[\w-]+\s+){0,4}medical\s+device", True),
    rx(r"Class\s+I\b.*?\bmedical\s+device", True),
)
MR_CONDITIONAL = rx(r"\bMR\s+[Cc]onditional\b")
BODY_NUMBER = rx(r"\b(?:NB|Notified\s+Body)(?:[:\s]+(?:ID\s+)?(?:number\s+)?)?\d{4}\b", True)
UDI_LABEL = rx(r"\bBasic\s+UDI[-\s]DI\b|\bEUDAMED\b", True)
UDI_CODE = rx(r"(?<![A-Za-z\d/])\d{10,14}[A-Za-z][A-Za-z0-9]*\b")
EMDN_LABEL = rx(r"\bEMDN\b", True)
EMDN_CODE = rx(r"(?<![A-Za-z\d])[A-Z]\d{8,12}(?![A-Za-z\d])")
STANDARD = rx(r"\b(EN\s+ISO|USP-NF|ISO|IEC|ASTM|EN)[ \t]+([A-Za-z0-9<][A-Za-z0-9\-.:/<>]*(?:[ \t]+[0-9<][A-Za-z0-9\-.:/<>]*)?)", True)
PERFORMANCE = rx(r"\b(?:primary\s+endpoint|response\s+rate|sensitivity|specificity|clinical\s+performance|intended\s+use|intended\s+purpose|primary\s+outcome|efficacy|effectiveness)\b", True)
PERFORMANCE_BARE = rx(r"\b(?:outcome|incidence)\b", True)
APPLICABLE = ("yes", "y", "true", "1", "applicable")
NOT_APPLICABLE = ("no", "n", "false", "0", "not applicable", "n/a", "na")
REQUIREMENT, APPLIES, EVIDENCE, STATUS = (f"(?i){x}" for x in ("B=Requirement", "C=Applicable", "D=Evidence_Document", "E=Status"))
ROW = r"^[^:]+:[A-Z](\d+)$"
METHOD = {
    "percentage": "extract.numeric.percentage:v1",
    "ci": "extract.numeric.ci:v1",
    "count": "extract.numeric.count:v1",
    "value_unit": "extract.numeric.value_unit:v1",
    "class": "extract.classification:v1",
    "performance": "extract.clinical_performance:v1",
    "citation": "extract.citation.author_year:v1",
    "completeness": "extract.completeness.gspr:v1",
    "mr_conditional": "extract.classification.mr_conditional:v1",
    "nb_number": "extract.classification.nb_number:v1",
    "basic_udi_di": "extract.classification.basic_udi_di:v1",
    "emdn_code": "extract.classification.emdn_code:v1",
    "standard": "extract.classification.harmonized_standard:v1",
}
# End of the fixed values.

# What each match of a pattern holds in lower case; few texts hold any of it.
OF_UNITS = ("mmhg", "atm", "gauss/cm", "w/kg", "°c", "day", "year")
OF_STANDARDS = ("iso", "iec", "astm", "usp-nf", "en ", "en\t")
OF_PERFORMANCE = ("endpoint", "response", "sensitivity", "specificity", "performance", "intended", "outcome", "efficacy", "effectiveness")

CLAIM = "array<struct<text:string,claim_type:string,method:string,normalised:string,number:int>>"
FOUND = "array<struct<start:int,end:int,text:string>>"


def _claims(rows: Column, kind: str, method: str, same: str = "normalised", numbered: bool = True) -> Column:
    """The matches ``rows`` as claims, numbered among those of equal ``same``."""
    rows = F.transform(rows, lambda m: F.struct(m["text"].alias("text"), F.lit(kind).alias("claim_type"), F.lit(METHOD[method]).alias("method"), normalised(m["text"]).alias("normalised")))

    def numbered_rows(bound: Column) -> Column:
        number = occurrences(bound, same) if numbered else F.transform(bound, lambda _: F.lit(1))
        return F.zip_with(bound, number, lambda r, n: F.struct(r["text"], r["claim_type"], r["method"], r["normalised"], n.cast("int")))

    return let(rows, numbered_rows).cast(CLAIM)


def _with_text(rows: Column, text) -> Column:
    return F.transform(rows, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), text(m).alias("text")))


def numeric(text: Column) -> Column:
    """Percentages with and without interval, intervals and counts, in this order."""

    def given(both: Column) -> Column:
        shown = _with_text(both, lambda m: F.concat_ws(" ", F.regexp_extract(m["text"], PERCENT_CI, 1), strip(F.regexp_extract(m["text"], PERCENT_CI, 2))))
        free = lambda rows: F.filter(rows, lambda m: ~blocked(both, m["start"], m["end"]))
        bare = F.when(noise.sizing_table(text), F.array().cast(FOUND)).otherwise(F.concat(free(find_all(text, PERCENT, "%")), free(find_all(text, PERCENT_WORD, "percent", low=True))))
        trimmed = lambda rows: _with_text(rows, lambda m: strip(m["text"]))
        return F.concat(
            _claims(F.concat(shown, trimmed(bare)), "numeric", "percentage"),
            _claims(trimmed(free(find_all(text, CI_RANGE, "CI"))), "numeric", "ci"),
            _claims(find_all(text, COUNT, "="), "numeric", "count"),
        )

    return let(find_all(text, PERCENT_CI, "%"), given)


def value_unit(text: Column) -> Column:
    """Values with a unit in eight passes; what an earlier one took blocks later overlaps."""
    around = lambda m, n: F.substring(text, F.greatest(m["start"] - n, F.lit(0)) + 1, m["end"] + n - F.greatest(m["start"] - n, F.lit(0)))
    tesla = F.filter(find_all(text, TESLA, "T"), lambda m: around(m, IMAGING_WINDOW).rlike(IMAGING))
    mark = F.locate(BURST_MARK, text) - 1
    burst = F.filter(find_all(text, BURST, "RBP"), lambda m: (mark >= 0) & (F.abs(m["start"] - mark) <= BURST_WINDOW))
    wide = lambda m: F.when(mark < m["end"], F.substring(text, mark + 1, m["end"] - mark)).otherwise("")
    burst = F.transform(burst, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(i == 0, wide(m)).otherwise(m["text"]).alias("text")))
    passes = [find_all(text, p, *signs) for p, *signs in ((RANGE, "to", "TO", "To", "tO"), (MEAN_SD, "±"), (DRIFT,), (WORDED,), (SIGNED, "≥", "≤", ">", "<"), (SINGLE,))]
    passes = F.when(let(F.lower(text), lambda low: holds(low, *OF_UNITS)), F.concat(*passes)).otherwise(F.array().cast(FOUND))
    kept = F.aggregate(F.concat(passes, tesla, burst).cast(FOUND), F.array().cast(FOUND), lambda acc, m: F.when(blocked(acc, m["start"], m["end"]), acc).otherwise(F.concat(acc, F.array(m))))
    return _claims(kept, "numeric", "value_unit")


def entities(text: Column) -> Column:
    """Device classes, labels, codes and standards."""
    low = F.lower(text)
    first = F.array_compact(F.array(*[F.when(holds(low, "medical") & text.rlike(p), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), strip(F.regexp_extract(text, p, 0)).alias("text"))) for p in CLASSES]))
    labelled = lambda label, code, *signs: F.when(holds(low, *signs) & text.rlike(label), find_all(text, code)).otherwise(F.array().cast(FOUND))
    standards = F.filter(find_all(text, STANDARD, *OF_STANDARDS, low=True), lambda m: F.regexp_extract(m["text"], STANDARD, 2).rlike(r"(?U)\d") & (F.length(F.regexp_extract(m["text"], STANDARD, 2)) >= 3))
    standards = _with_text(standards, lambda m: F.concat_ws(" ", F.regexp_extract(m["text"], STANDARD, 1), F.regexp_extract(m["text"], STANDARD, 2)))
    return F.concat(
        _claims(first, "classification", "class", numbered=False),
        _claims(find_all(text, MR_CONDITIONAL, "MR"), "classification", "mr_conditional", "text"),
        _claims(find_all(text, BODY_NUMBER, "nb", "notified", low=True), "classification", "nb_number", "text"),
        _claims(labelled(UDI_LABEL, UDI_CODE, "udi", "eudamed"), "classification", "basic_udi_di", "text"),
        _claims(labelled(EMDN_LABEL, EMDN_CODE, "emdn"), "classification", "emdn_code", "text"),
        _claims(standards, "standard_reference", "standard", "text"),
    )


def performance(text: Column, kind: Column) -> Column:
    """Windows around performance words, equal ones once; not in table cells.

    A page loses its running header first; if it had one, two further words count.
    """

    def windows(body: Column) -> Column:
        words = F.concat(find_all(body, PERFORMANCE, *OF_PERFORMANCE, low=True), F.when(body != text, find_all(body, PERFORMANCE_BARE, "outcome", "incidence", low=True)).otherwise(F.array().cast(FOUND)))

        def window(m: Column) -> Column:
            start = F.greatest(m["start"] - PERFORMANCE_WINDOW, F.lit(0))
            return strip(F.substring(body, start + 1, m["end"] + PERFORMANCE_WINDOW - start))

        rows = F.filter(_with_text(words, window), lambda m: ~m["text"].rlike(noise.BOILERPLATE))
        return F.filter(_claims(rows, "clinical_performance", "performance"), lambda c: c["number"] == 1)

    body = F.when(kind == "page", noise.without_header(text)).otherwise(text)
    return F.when(kind == "table_cell", F.array().cast(CLAIM)).otherwise(let(body, windows))


def cited(text: Column, kind: Column, document: Column) -> Column:
    """Every mention but the bracketed numbers, numbered among equal markers of any form."""
    rows = F.filter(mentions_of(text, kind, document), lambda m: m["marker_form"] != "numeric_bracketed")
    rows = F.transform(rows, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), strip(m["marker_text"]).alias("text")))
    return _claims(rows, "citation", "citation")


def row_number_of(label: Column) -> Column:
    """The row of a cell label with a one-letter column; the sheet does not count."""
    found = F.regexp_extract(label, ROW, 1)
    return F.when(found != "", found.cast("bigint"))


def requirement_gaps(spans: DataFrame) -> DataFrame:
    """Requirement cells of applicable rows without an evidence cell; spans need document_kind."""
    cells = spans.withColumn("row", row_number_of(F.col("location_label"))).where("row is not null and text is not null")
    section = F.coalesce("section", F.lit(""))
    value = normalised(F.col("text"))
    order = F.struct("location_index", "span_id")
    rows = cells.groupBy("document_id", "row").agg(
        F.max_by(F.when(section.rlike(APPLIES), value), F.when(section.rlike(APPLIES), order)).alias("applies"),
        F.max_by(F.when(section.rlike(STATUS) & ~section.rlike(APPLIES), value), F.when(section.rlike(STATUS) & ~section.rlike(APPLIES), order)).alias("status"),
        F.bool_or(section.rlike(EVIDENCE)).alias("has_evidence"),
    )
    rows = rows.where(F.col("applies").isin(*APPLICABLE) & ~F.coalesce(F.col("status").isin(*NOT_APPLICABLE), F.lit(False)) & ~F.col("has_evidence"))
    needs = cells.where((F.col("document_kind") == "GSPR_MAPPING") & section.rlike(REQUIREMENT) & (strip(F.col("text")) != "") & ~F.col("suppress_claims"))
    return needs.join(rows.select("document_id", "row"), ["document_id", "row"], "left_semi")


FAMILIES = {
    "numeric": lambda text, kind, document: numeric(text),
    "value_unit": lambda text, kind, document: value_unit(text),
    "entities": lambda text, kind, document: entities(text),
    "performance": lambda text, kind, document: performance(text, kind),
    "citation": cited,
}


def claims(spans: DataFrame, documents: DataFrame, *families: str) -> DataFrame:
    """One row per claim: claim_id, document_id, span_id, text, claim_type, extraction_method, confidence_label.

    ``families`` of ``FAMILIES``, or "completeness", if given, limits the claims to these.
    Spans that are no evidence text give none, as do null texts; ids may repeat
    where two spellings of an entity differ in case only; a repeated span gives
    its claims again, equal in every column, so that ``distinct`` leaves them once.
    """
    rows = noise.classified(spans, documents)
    text, kind, document = F.col("text"), F.col("location_kind"), F.col("document_id")
    found = F.concat(*[f(text, kind, document) for name, f in FAMILIES.items() if not families or name in families] or [F.array().cast(CLAIM)])
    each = rows.where(text.isNotNull() & ~F.col("suppress_claims")).select("document_id", "span_id", F.explode(found).alias("c"))
    each = each.select("document_id", "span_id", "c.*")
    gaps = requirement_gaps(rows).select("document_id", "span_id", strip(text).alias("text"), F.lit("completeness").alias("claim_type"), F.lit(METHOD["completeness"]).alias("method"), normalised(text).alias("normalised"), F.lit(1).alias("number"))
    every = each.unionByName(gaps) if not families or "completeness" in families else each
    return every.select(
        claim_id(F.col("document_id"), F.col("span_id"), F.col("normalised"), F.col("method"), F.col("number")).alias("claim_id"),
        "document_id",
        "span_id",
        "text",
        "claim_type",
        F.col("method").alias("extraction_method"),
        F.lit("high").alias("confidence_label"),
    )
