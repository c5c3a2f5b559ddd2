"""Sources that documents provide or refer to, and links from claims to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ids import link_id, source_id
from claimloom.functions.text import rx, strip
from claimloom.operators.citations import author_year_key
from claimloom.operators.claims import EVIDENCE, REQUIREMENT

# Patterns and the words of the output.
PDF_AUTHOR_YEAR = rx(r"([A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+et\s+al\.?)?)[\s.,]*\(?((?:19|20)\d{2})\)?")
CELL_ROW = r":[A-Z]+(\d+)$"
AUTHOR_YEAR_FORMS = ("author_year_parenthetical", "author_year_table_cell")
LOCAL, MISSING = "local_fulltext", "missing_file"
# End of the fixed values.

NO_IDS = "array<string>"


def local_sources(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """A source per SOURCE_PDF document, keyed by the first page with an author and year."""
    pdfs = documents.where("kind = 'SOURCE_PDF'").select("document_id", "path").distinct()
    key = author_year_key(F.regexp_extract("text", PDF_AUTHOR_YEAR, 1), F.regexp_extract("text", PDF_AUTHOR_YEAR, 2))
    keyed = spans.where(F.col("text").rlike(PDF_AUTHOR_YEAR)).select("document_id", key.alias("key"), F.struct("location_index", "span_id").alias("place"))
    keyed = keyed.where(~F.startswith("key", F.lit("unknown_"))).groupBy("document_id").agg(F.min_by("key", "place").alias("citation_key"))
    rows = pdfs.join(keyed, "document_id", "left")
    return rows.select(source_id(F.coalesce("path", F.lit("")), F.col("citation_key")).alias("source_id"), "path", "citation_key", F.lit(LOCAL).alias("availability_status"))


def missing_sources(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """A source per file that an evidence cell names and no document is."""
    mapping = documents.where("kind = 'GSPR_MAPPING'").select("document_id").distinct()
    cells = spans.where((F.col("location_kind") == "table_cell") & F.col("section").rlike(EVIDENCE)).join(mapping, "document_id", "left_semi")
    named = cells.select(strip(F.col("text")).alias("path"), "span_id").where("path <> ''")
    known = documents.where("path <> ''").select(F.explode(F.array("path", F.element_at(F.split("path", "/"), -1))).alias("path")).distinct()
    rows = named.join(known, "path", "left_anti").groupBy("path").agg(F.sort_array(F.collect_set("span_id")).alias("origin_span_ids"))
    none = F.lit(None).cast("string")
    return rows.select(source_id(F.col("path"), none).alias("source_id"), "path", none.alias("citation_key"), F.lit(MISSING).alias("availability_status"), "origin_span_ids")


def sources(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """source_id, path, citation_key, availability_status, origin_span_ids; one row per source_id."""
    local = local_sources(documents, spans).dropDuplicates(["source_id"])
    missing = missing_sources(documents, spans).join(local.select("source_id"), "source_id", "left_anti")
    return local.withColumn("origin_span_ids", F.array().cast(NO_IDS)).unionByName(missing)


def _pairs(spans: DataFrame) -> DataFrame:
    """Requirement span and the evidence file of its row, null if the row names none."""
    row = F.regexp_extract("location_label", CELL_ROW, 1)
    cells = spans.where((F.col("location_kind") == "table_cell") & (row != "")).select("document_id", row.cast("bigint").alias("row"), "section", "span_id", "text", "location_index")
    section = F.coalesce("section", F.lit(""))
    need, file = section.rlike(REQUIREMENT), section.rlike(EVIDENCE) & ~section.rlike(REQUIREMENT)
    place = F.struct("location_index", "span_id")
    rows = cells.groupBy("document_id", "row").agg(
        F.max_by(F.when(need, F.col("span_id")), F.when(need, place)).alias("span_id"),
        F.max_by(F.when(file, strip(F.col("text"))), F.when(file, place)).alias("file"),
    )
    return rows.where("span_id is not null").select("span_id", F.col("file").alias("evidence_file"), F.lit(True).alias("paired")).dropDuplicates(["span_id"])


def links(claims: DataFrame, citations: DataFrame, sources_: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """One link per claim row: evidence_link_id, claim_id, source_id, status, linking_method, candidate_source_ids.

    In this order: the span's first author-year mention with exactly one local
    source of its key; several local sources; a bracketed number; a class; a
    requirement row's missing or absent evidence file; else manual review. Null
    keys match nothing.
    """
    local = sources_.where(f"availability_status = '{LOCAL}' and citation_key is not null")
    by_key = local.groupBy("citation_key").agg(F.sort_array(F.collect_set("source_id")).alias("ids"))
    cited = citations.where(F.col("marker_form").isin(*AUTHOR_YEAR_FORMS) & F.col("normalized_key").isNotNull())
    cited = cited.join(by_key, cited["normalized_key"] == by_key["citation_key"]).select("span_id", "mention_id", "ids")
    one = F.when(F.size("ids") == 1, F.col("ids")[0])
    per_span = cited.groupBy("span_id").agg(
        F.min_by(one, F.when(F.size("ids") == 1, F.col("mention_id"))).alias("resolved"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.size("ids") > 1, F.col("ids")))))).alias("candidates"),
    )
    bracketed = citations.where("marker_form = 'numeric_bracketed'").select("span_id").distinct().withColumn("bracketed", F.lit(True))
    rows = claims.select("claim_id", "span_id", "claim_type").join(per_span, "span_id", "left").join(bracketed, "span_id", "left")
    if spans is None:
        rows = rows.withColumns({"evidence_file": F.lit(None).cast("string"), "paired": F.lit(False), "missing_id": F.lit(None).cast("string")})
    else:
        missing = sources_.where(f"availability_status = '{MISSING}' and path is not null").groupBy(F.col("path").alias("evidence_file")).agg(F.max("source_id").alias("missing_id"))
        rows = rows.join(_pairs(spans), "span_id", "left").join(missing, "evidence_file", "left")
    complete = F.col("claim_type") == "completeness"
    choice = (
        F.when(F.col("resolved").isNotNull(), _choice("resolved", "explicit_citation", F.col("resolved")))
        .when(F.size(F.coalesce("candidates", F.array().cast(NO_IDS))) > 0, _choice("source_ambiguous", "explicit_citation_ambiguous", candidates=F.col("candidates")))
        .when(F.col("bracketed"), _choice("source_unresolved", "no_link_found"))
        .when(F.col("claim_type") == "classification", _choice("manual_review_required", "no_link_found"))
        .when(complete & F.col("missing_id").isNotNull(), _choice("source_missing", "filename_reference", F.col("missing_id")))
        .when(complete & F.col("paired") & F.col("evidence_file").isNull(), _choice("source_missing", "no_link_found"))
        .otherwise(_choice("manual_review_required", "no_link_found"))
    )
    rows = rows.select("claim_id", choice.alias("c")).select("claim_id", "c.*")
    return rows.select(link_id(F.col("claim_id"), F.col("source_id"), F.col("status"), F.col("candidate_source_ids")).alias("evidence_link_id"), "claim_id", "source_id", "status", "linking_method", "candidate_source_ids")


def _choice(status: str, method: str, source: Column | None = None, candidates: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (none if source is None else source).alias("source_id"),
        F.lit(status).alias("status"),
        F.lit(method).alias("linking_method"),
        (F.array().cast(NO_IDS) if candidates is None else candidates).alias("candidate_source_ids"),
    )
