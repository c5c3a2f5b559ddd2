"""The corpus queries by name, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import canonical, leakage, lookalike, markup, mixing, reading, siteline
from claimloom.sources.tables import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that look the same, and anchors with a look-alike match word."""
    pairs = lookalike.same_look_pairs(table(spark, sf_dir, "spans"), "span_id", "text")
    return pairs.unionByName(lookalike.meant_words(table(spark, sf_dir, "source_anchors"), "anchor_id", "matched_via"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure kept of each document, and the previews that hold markup."""
    found = markup.structure(table(spark, sf_dir, "extracted_markdown"), "md_id", "markdown_text")
    marked = markup.residue(table(spark, sf_dir, "source_anchors"), "anchor_id", "preview")
    return found.unionByName(marked.withColumns({"part_kind": F.lit("residue"), "plain_text": F.lit("")}))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as clean text."""
    return markup.cleaned(table(spark, sf_dir, "extracted_markdown"), "md_id", "markdown_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat over a dossier's documents."""
    return siteline.repeated_lines(table(spark, sf_dir, "spans"), table(spark, sf_dir, "dossier_documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry meant by each mention and graph source without a literal key."""
    mentions, graph, references = (table(spark, sf_dir, t) for t in ("citation_mentions", "graph_records", "reference_sources"))
    return canonical.resolve(canonical.unkeyed(mentions, graph, references), references)


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a third of a test item, edited or not, with what they hold of it."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a third of a test item word for word."""
    return leakage.exactly(p6_leaks(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked test items with the number of documents that hold them."""
    return leakage.leaked_items(leakage.exactly(p6_leaks(spark, sf_dir))).select("item_id", "n_docs")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = written(mixing.token_counts(table(spark, sf_dir, "documents")), "tokens")
    return mixing.mix(counts, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of documents that make up the mix."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached token shares of each source."""
    return _mixed(spark, sf_dir)[1]


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of each English document, with its source."""
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of each English document."""
    return p8_levels(spark, sf_dir).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and reading level."""
    return p8_levels(spark, sf_dir).groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"))


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p2_clean, p3_found, p5_found, p6_found, p6_leaks, p6_items, p7_mix, p7_shares, p8_found, p8_levels, p8_profile)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from claimloom.llm.sql import SQL

    return SQL
