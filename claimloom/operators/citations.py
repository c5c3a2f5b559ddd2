"""Citation markers in spans, as mentions with content-derived ids.

All forms of a span are found in its row; no shuffle is needed for the
occurrence counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ids import citation_id
from claimloom.functions.text import find_all, inside, let, occurrences, rx, strip
from claimloom.operators.spans import citation_noise

# Patterns and the parser's name.
AUTHORS = r"[A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?"
AUTHOR_YEAR = rx(rf"\(({AUTHORS})(?:,?\s*)((?:19|20)\d{{2}})\)")
AUTHOR_YEAR_CELL = rx(rf"^({AUTHORS})\s+((?:19|20)\d{{2}})(?:\s+n=\d+)?\s*$")
BRACKETED = rx(r"\[(\d{1,3})\]")
BRACKETED_LIST = rx(r"\[((?:\d{1,3}\s*,\s*)+\d{1,3})\]")
PARENTHESISED = rx(r"(?<![A-Za-z%])\((\d{1,2})\)(?![A-Za-z%\d])")
TRIAL = rx(r"\(?(NCT\d{8})\)?")
GUIDELINE = rx(r"([A-Z]{2,10}(?:/[A-Z]{2,10})*)\s+((?:19|20)\d{2})\s+[Gg]uidelines?\b")
REFERENCE = rx(r"REF-(\d{1,4})\b")
FIRST_NAME = r"[A-Z][a-z]+"
PARSER = "citation_parser:v1"
# End of the fixed values.

MENTION = "array<struct<marker_text:string,marker_form:string,normalized_key:string,marker:string,start:int,end:int>>"


def author_year_key(authors: Column, year: Column) -> Column:
    """The first capitalised word in lower case and the year; ``unknown`` without one."""
    name = F.regexp_extract(authors, FIRST_NAME, 0)
    return F.concat_ws("_", F.when(name == "", "unknown").otherwise(F.lower(name)), year)


def short_document_id(document: Column) -> Column:
    """The first eight hex digits behind ``doc_``; null if there are fewer."""
    found = F.regexp_extract(document, r"^doc_([0-9a-f]{8})[0-9a-f]*$", 1)
    return F.when(found != "", found)


def _mention(found: Column, form: str, key: Column, marker: Column | None = None, text: Column | None = None) -> Column:
    text = found["text"] if text is None else text
    return F.struct(
        text.alias("marker_text"),
        F.lit(form).alias("marker_form"),
        key.cast("string").alias("normalized_key"),
        (F.lower(text) if marker is None else marker).alias("marker"),
        found["start"].alias("start"),
        found["end"].alias("end"),
    )


def mentions_of(text: Column, kind: Column, document: Column) -> Column:
    """The mentions of one span, by form and within a form by place."""
    group = lambda m, pattern, k: F.regexp_extract(m["text"], pattern, k)
    none = F.lit(None).cast("string")
    listed = lambda m: F.transform(F.split(group(m, BRACKETED_LIST, 1), ","), lambda n: _mention(m, "numeric_bracketed", none, text=F.concat(F.lit("["), strip(n), F.lit("]"))))
    short = short_document_id(document)

    def with_trials(trials: Column) -> Column:
        notes = F.when(short.isNotNull(), F.filter(find_all(text, PARENTHESISED, "("), lambda m: ~inside(trials, m["start"], m["end"])))
        return F.concat(
            F.transform(trials, lambda m: _mention(m, "nct_id", F.concat(F.lit("nct_"), F.substring(group(m, TRIAL, 1), 4, 8)), F.lower(group(m, TRIAL, 1)))).cast(MENTION),
            F.coalesce(F.transform(notes, lambda m: _mention(m, "numeric_parenthetical", F.concat_ws("_", F.lit("footnote"), short, group(m, PARENTHESISED, 1)))).cast(MENTION), F.array().cast(MENTION)),
        )

    def with_lists(lists: Column) -> Column:
        single = F.filter(find_all(text, BRACKETED, "["), lambda m: ~inside(lists, m["start"], m["end"]))
        return F.concat(F.flatten(F.transform(lists, listed)).cast(MENTION), F.transform(single, lambda m: _mention(m, "numeric_bracketed", none)).cast(MENTION))

    forms = F.concat(
        let(find_all(text, TRIAL, "NCT"), with_trials),
        F.transform(find_all(text, GUIDELINE, "uideline"), lambda m: _mention(m, "named_guideline", F.concat_ws("_", F.replace(F.lower(group(m, GUIDELINE, 1)), F.lit("/"), F.lit("_")), group(m, GUIDELINE, 2)))),
        F.transform(find_all(text, AUTHOR_YEAR, "("), lambda m: _mention(m, "author_year_parenthetical", author_year_key(group(m, AUTHOR_YEAR, 1), group(m, AUTHOR_YEAR, 2)))),
        let(find_all(text, BRACKETED_LIST, "["), with_lists),
        F.transform(find_all(text, REFERENCE, "REF-"), lambda m: _mention(m, "ref_id_numeric", F.concat(F.lit("ref_"), group(m, REFERENCE, 1)))),
    )
    cell = strip(text)
    start = F.length(F.regexp_extract(text, rx(r"^[\s\x1c-\x1f]*"), 0))
    place = F.struct(start.alias("start"), (start + F.length(cell)).alias("end"), cell.alias("text"))
    whole = F.array(_mention(place, "author_year_table_cell", author_year_key(F.regexp_extract(cell, AUTHOR_YEAR_CELL, 1), F.regexp_extract(cell, AUTHOR_YEAR_CELL, 2))))
    return F.when((kind == "table_cell") & cell.rlike(AUTHOR_YEAR_CELL), whole.cast(MENTION)).otherwise(forms.cast(MENTION))


def mentions(spans: DataFrame) -> DataFrame:
    """One row per citation mention of ``spans``.

    Spans with null text or id give none; bibliographies, contents, headings,
    page furniture and templates are skipped; a repeated span gives its mentions
    again; other columns of the spans are left behind.
    """
    rows = spans.where(F.col("text").isNotNull() & ~citation_noise())
    found = mentions_of(F.col("text"), F.col("location_kind"), F.col("document_id"))
    rows = rows.select("document_id", "span_id", found.alias("found"))
    rows = rows.withColumn("number", occurrences(F.col("found"), "marker_form", "marker"))
    rows = rows.select("document_id", "span_id", F.explode(F.arrays_zip("found", "number")).alias("m"))
    m = F.col("m.found")
    return rows.select(
        citation_id(F.col("document_id"), F.col("span_id"), m["marker"], F.lit(PARSER), F.col("m.number")).alias("mention_id"),
        "document_id",
        "span_id",
        m["marker_text"].alias("marker_text"),
        m["marker_form"].alias("marker_form"),
        m["normalized_key"].alias("normalized_key"),
        F.col("m.number").alias("occurrence_index"),
        m["start"].alias("span_offset_start"),
        m["end"].alias("span_offset_end"),
    )
