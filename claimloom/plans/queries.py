"""The queries of the core by name, for the entry module, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import ids
from claimloom.functions.text import find_all, strip
from claimloom.operators import checkers, citations, claims, graph, guidance, layout, sources, units, validate
from claimloom.operators import spans as span_ops
from claimloom.sources.tables import table, written

Query = Callable[[SparkSession, str], DataFrame]
SPAN = ["span_id", "document_id", "location_kind", "location_index", "location_label", "section", "text"]


def delivered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as delivered, some of them again.

    Operators that work in the row of a span give equal rows for equal spans, so
    queries make their small results distinct instead of shuffling all texts.
    """
    rows = table(spark, sf_dir, "spans").select(*SPAN)
    cores = spark.sparkContext.defaultParallelism
    # A few small files would leave most cores idle; at scale a scan has more parts than that.
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans once each, for queries that need their texts together."""
    return delivered_spans(spark, sf_dir).distinct()


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dossier_documents")


def mentions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered citation mentions, once each."""
    return table(spark, sf_dir, "citation_mentions").distinct()


def graph_sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source records of the delivered graph in the shape of ``sources``."""
    rows = table(spark, sf_dir, "graph_records").where("record_type = 'source'")
    rows = rows.groupBy("record_id").agg(F.max("path").alias("path"), F.max("citation_key").alias("citation_key"), F.max("availability_status").alias("availability_status"))
    return rows.withColumnRenamed("record_id", "source_id").withColumn("origin_span_ids", F.array().cast("array<string>"))


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir).select("document_id", span_ops.inferred_kind(F.col("path")).alias("inferred_kind"))


def document_kinds_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir).select("document_id", span_ops.inferred_kind(F.col("path")).alias("kind"))
    return span_ops.refined_kinds(documents, delivered_spans(spark, sf_dir))


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir).select("document_id", ids.document_id(F.col("kind"), F.col("path"), F.col("sha256")).alias("computed_id"))


def span_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ids.span_id(*(F.col(c) for c in ("document_id", "location_kind", "location_index", "location_label", "text")))
    return delivered_spans(spark, sf_dir).select("span_id", made.alias("computed_id")).distinct()


def span_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = span_ops.classified(delivered_spans(spark, sf_dir), documents_of(spark, sf_dir))
    return rows.select("span_id", F.array_join("reasons", ",").alias("reasons"), "suppress_claims", "citation_noise", "retain_as_anchor").distinct()


def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions per span, form, marker and key."""
    found = citation_mention_ids(spark, sf_dir)
    return found.groupBy("span_id", "marker_form", "marker_text", "normalized_key").agg(F.count("*").alias("n"))


def citation_mention_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.mentions(delivered_spans(spark, sf_dir)).distinct()


def count_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the count form of spans that are evidence text."""
    found = claims.claims(delivered_spans(spark, sf_dir), documents_of(spark, sf_dir), "numeric").distinct()
    return found.where(F.col("extraction_method") == claims.METHOD["count"]).select("claim_id", "span_id", "text")


def percentage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of percentage claims per span."""
    found = claims.claims(delivered_spans(spark, sf_dir), documents_of(spark, sf_dir), "numeric").distinct()
    return found.where(F.col("extraction_method") == claims.METHOD["percentage"]).groupBy("span_id").agg(F.count("*").alias("n"))


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.claims(delivered_spans(spark, sf_dir), documents_of(spark, sf_dir)).distinct()


def requirement_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement cells of applicable rows without evidence."""
    rows = span_ops.classified(delivered_spans(spark, sf_dir), documents_of(spark, sf_dir))
    return claims.requirement_gaps(rows).select("document_id", "row", "span_id").distinct()


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.sources(documents_of(spark, sf_dir), delivered_spans(spark, sf_dir))
    return found.select("source_id", "path", "citation_key", "availability_status", F.array_join("origin_span_ids", ",").alias("origin_span_ids"))


def _end_to_end(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    spans, documents = delivered_spans(spark, sf_dir), documents_of(spark, sf_dir)
    made = written(claim_rows(spark, sf_dir), "claims")
    cited = written(citation_mention_ids(spark, sf_dir), "mentions")
    found = written(sources.sources(documents, spans), "sources")
    linked = written(sources.links(made, cited, found, spans), "links")
    return made, cited, found, linked, checkers.findings(made, cited, found, linked)


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _end_to_end(spark, sf_dir)[3].withColumn("candidate_source_ids", F.array_join("candidate_source_ids", ","))


def pipeline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _end_to_end(spark, sf_dir)[4].withColumn("affected_object_ids", F.array_join("affected_object_ids", ";"))


def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkers.by_severity(_end_to_end(spark, sf_dir)[4])


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph records per family."""
    made, cited, found, linked, findings = _end_to_end(spark, sf_dir)
    documents = documents_of(spark, sf_dir).drop("metadata", "received_at")
    families = {"document": documents, "span": spans_of(spark, sf_dir), "claim": made, "citation": cited, "source": found, "evidence_link": linked, "finding": findings}
    return graph.records(families).groupBy("family_pos", "record_type").agg(F.count("*").alias("n"))


def broken_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the delivered mentions against the delivered source records."""
    found = checkers.broken_citations(mentions_of(spark, sf_dir), graph_sources_of(spark, sf_dir))
    return found.select("eco_id", "finding_type", F.array_join("affected_object_ids", ";").alias("affected_object_ids"))


def mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered mention as a claim of its span, linked to the delivered sources."""
    cited, found = mentions_of(spark, sf_dir), graph_sources_of(spark, sf_dir)
    found = found.withColumn("availability_status", F.when(F.col("availability_status") == "missing_file", "local_fulltext").otherwise(F.col("availability_status")))
    rows = cited.select(F.col("mention_id").alias("claim_id"), "document_id", "span_id", F.col("marker_text").alias("text"), F.lit("citation").alias("claim_type"))
    return sources.links(rows, cited, found).select("claim_id", "source_id", "status", "linking_method", F.array_join("candidate_source_ids", ",").alias("candidates"))


def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mentions name and the delivered graph has no record of."""
    named = mentions_of(spark, sf_dir).select(F.array("document_id").alias("affected_object_ids"))
    return graph.unresolved_ids(named, table(spark, sf_dir, "graph_records"))


def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five spans of each dossier for each keyword rule."""
    found = guidance.rule_matches(delivered_spans(spark, sf_dir), documents_of(spark, sf_dir), "dossier_id")
    return found.select("rule_id", "dossier_id", "match_no", "span_id", "matched_pattern", "span_text_preview")


def anchor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page mark before each anchor."""
    texts = table(spark, sf_dir, "extracted_markdown").select("md_id", "markdown_text").distinct()
    rows = table(spark, sf_dir, "source_anchors").select("anchor_id", "md_id", "char_offset").join(texts, "md_id")
    return rows.select("anchor_id", guidance.preceding_page(F.col("markdown_text"), F.col("char_offset")).alias("page"))


def excerpt_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the text of each anchor's preview first stands in its document."""
    texts = table(spark, sf_dir, "extracted_markdown").select("md_id", F.col("markdown_text").alias("text")).distinct()
    rows = table(spark, sf_dir, "source_anchors").select(F.col("anchor_id").alias("excerpt_id"), "md_id", F.col("preview").alias("excerpt"))
    return guidance.anchors(rows.join(texts, "md_id"))


def layout_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.normalise(spans_of(spark, sf_dir).select("span_id", "text"))
    return rows.select("span_id", "text", F.array_join("applied", ",").alias("applied"))


def layout_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of sizes, with order lines as characters and their quantity as size."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").cast("double").alias("size"))
    return layout.heading_levels(rows, "doc")


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spans_of(spark, sf_dir).where("location_kind = 'page'")
    return pages.select("document_id", F.col("location_index").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def layout_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at the top or bottom of most pages of a document."""
    return layout.running_lines(_page_lines(spark, sf_dir), "document_id")


def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each document without running lines."""
    lines = written(_page_lines(spark, sf_dir).withColumn("size", F.lit(10.0)), "page-lines")
    levels = layout.heading_levels(lines.select("document_id", "size"), "document_id")
    return layout.assembled(lines, levels, layout.running_lines(lines, "document_id"), "document_id")


def table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural violations of the delivered tables."""
    spans, documents = table(spark, sf_dir, "spans"), documents_of(spark, sf_dir)
    anchors = table(spark, sf_dir, "source_anchors")
    return validate.all_issues(
        validate.duplicated(spans, "span_id"),
        validate.outside(spans, "span_id", "location_kind", ["paragraph", "page"]),
        validate.unknown(anchors, "anchor_id", "md_id", table(spark, sf_dir, "extracted_markdown"), "md_id"),
        validate.outside(anchors, "anchor_id", "matched_via", ["verbatim", "whitespace_normalised"]),
        validate.absent(documents, "document_id", "metadata", ["extension", "maker"]),
        validate.blank(spans, "span_id", "text", "location_label"),
    )


def p4_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with its status and its value in the common unit."""
    return units.common_units(*(table(spark, sf_dir, t) for t in ("demo_numeric_facts", "spans", "measure_labels")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts recorded in another unit than their label's."""
    return p4_facts(spark, sf_dir).where(F.col("status") == "converted").select("gold_id", "common_unit", "value_scaled")


def queries() -> dict[str, Query]:
    found = (
        p4_found, p4_facts, document_kinds, document_kinds_refined, document_ids, span_ids, span_noise, citation_forms, citation_mention_ids,
        count_claims, percentage_claims, claim_rows, requirement_gaps, source_rows, evidence_links, pipeline_findings, findings_by_severity,
        graph_counts, broken_citations, mention_links, graph_closure, rule_evidence, anchor_pages, excerpt_anchors, layout_normalised,
        layout_heading_levels, layout_running_lines, layout_documents, table_issues,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from claimloom.plans import claims_sql, sql

    return sql.SQL | claims_sql.SQL
