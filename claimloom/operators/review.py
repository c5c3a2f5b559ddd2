"""Rule packs and their sources, what the spans give for each rule, and the review list made of both.

A pack is a folder with ``rules.json`` (an object with a list ``rules``),
``sources.json`` (an object with a list ``sources``) and Markdown files that the
sources name. Only the mechanism is here; what a rule says comes from the pack.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import guidance

# Words of the output, and the fields of packs, sources and front matter.
NOT_EVALUATED, BY_KEYWORDS, BY_HUMANS = "not_evaluated", "deterministic_keyword_match", "human_review_only"
TO_CONFIRM, BOUNDARY, SCHEMA = "needs_human_confirmation", "not_an_ECO_finding", "guidance.checklist.v1"
RULE_FIELDS = ("rule_id", "source_id", "target_document_type", "modal_strength", "automation_readiness", "RA_review_status", "exact_excerpt", "source_hash", "source_url_or_local_path", "source_version", "paraphrase", "notes")
SOURCE_FIELDS = ("source_id", "title", "derived_md_path_optional", "derived_md_sha256_optional")
REQUIRED_FIELDS = ("source_id", "document_family", "derived_from_source_id", "derived_md_review_status")
REFERENCE_FIELDS = ("source_id", "relation", "cited_at")
RUN_FIELDS = ("claims", "citations", "sources", "evidence_links", "findings", "graph_records")
# End of the fixed values.

MATCH = "array<struct<document_id:string,span_id:string,matched_pattern:string,span_text_preview:string>>"
ANCHOR = "struct<md_path:string,char_offset:int,line_number:int,page_anchor:int,preview:string,matched_via:string>"


def _listed(spark: SparkSession, path: str, name: str, fields: tuple[str, ...]) -> DataFrame:
    """The objects of the list ``name`` in a JSON file, in order: ``pos`` and the ``fields``, those absent as null."""
    kind = ", ".join(f"`{f}`: string" for f in fields)
    body = spark.read.text(path, wholetext=True)
    schema = f"struct<{name}: array<struct<{kind}, source_excerpt_pending: boolean>>>"
    rows = body.select(F.posexplode(F.from_json("value", schema)[name]).alias("pos", "x"))
    return rows.where("x is not null").select("pos", *[F.col("x")[f].alias(f) for f in fields], F.coalesce(F.col("x.source_excerpt_pending"), F.lit(False)).alias("source_excerpt_pending"))


def rules_of(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of a pack in order; those without an id are left out."""
    return _listed(spark, f"{folder}/rules.json", "rules", RULE_FIELDS).where("rule_id <> ''")


def sources_of(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(spark, f"{folder}/sources.json", "sources", SOURCE_FIELDS).drop("source_excerpt_pending", "pos")


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """md_path (relative to ``folder``), text, sha256 of every Markdown file of a pack."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    base = folder.rstrip("/").removeprefix("file://").replace("\\", "\\\\") + "/"
    place = F.element_at(F.split("path", base, 2), -1)
    return files.select(place.alias("md_path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def source_texts(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """source_id, title, md_path, text, well_formed, fields, cross_refs, body of each source.

    A source without a Markdown file has null from ``text`` on; a malformed
    front matter leaves the whole text as body.
    """
    rows = sources.select("source_id", "title", F.col("derived_md_path_optional").alias("md_path")).join(texts.select("md_path", "text"), "md_path", "left")
    fronts = guidance.front_matters(rows.where("text is not null"), "source_id", "text").withColumnRenamed("key", "source_id")
    return rows.join(fronts, "source_id", "left")


def source(spark: SparkSession, folder: str, source_id: str) -> dict:
    """The one source of a pack with its text and front matter; KeyError if the pack has none of that id."""
    rows = sources_of(spark, folder).where(F.col("source_id") == source_id)
    found = source_texts(rows, texts_of(spark, folder)).first()
    if found is None:
        raise KeyError(source_id)
    return found.asDict(recursive=True)


def front_matter_issues(fronts: DataFrame, statuses: list[str]) -> DataFrame:
    """(key, field, issue) of front matters: "malformed", "required" fields that are blank, review states "outside" ``statuses``.

    fronts: key, well_formed, fields, cross_refs, as ``guidance.front_matters`` gives.
    """
    blank = lambda x, f: F.coalesce(F.trim(F.try_element_at(x, F.lit(f))), F.lit("")) == ""
    lacks = lambda f: F.exists("cross_refs", lambda x: blank(x, f))
    row = lambda field, issue: F.struct(F.lit(field).alias("field"), F.lit(issue).alias("issue"))
    fields, whole = F.col("fields"), F.col("well_formed")
    found = [F.when(~whole, row("", "malformed"))]
    found += [F.when(whole & blank(fields, f), row(f, "required")) for f in REQUIRED_FIELDS]
    status = F.try_element_at(fields, F.lit(REQUIRED_FIELDS[-1]))
    found.append(F.when(whole & ~blank(fields, REQUIRED_FIELDS[-1]) & ~status.isin(*statuses), row(REQUIRED_FIELDS[-1], "outside")))
    found += [F.when(lacks(f), row(f"cross_refs.{f}", "required")) for f in REFERENCE_FIELDS]
    return fronts.select("key", F.explode(F.array_compact(F.array(*found))).alias("x")).select("key", "x.*")


def repinned(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """``sources`` with the hash of their Markdown file as it is now, and ``changed``; without a file they stay as they are."""
    now = texts.select(F.col("md_path").alias("derived_md_path_optional"), "sha256")
    rows = sources.join(now, "derived_md_path_optional", "left")
    changed = F.col("sha256").isNotNull() & ~F.col("derived_md_sha256_optional").eqNullSafe(F.col("sha256"))
    return rows.withColumn("changed", changed).withColumn("derived_md_sha256_optional", F.coalesce("sha256", "derived_md_sha256_optional")).select(*sources.columns, "changed")


def evaluations(rules: DataFrame, spans: DataFrame, documents: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """rule_id, evaluation_status, evaluation_method, evidence_matches, source_anchor of each rule.

    Rules without a keyword list are not evaluated and have null matches; a rule
    whose source has a text (``texts``: source_id, md_path, text) has the place of
    its excerpt there, or null.
    """
    found = guidance.rule_matches(spans, documents)
    match = F.struct("match_no", "document_id", "span_id", "matched_pattern", "span_text_preview")
    found = found.groupBy("rule_id").agg(F.array_sort(F.collect_list(match)).alias("m"))  # no more than ``MATCHES`` of a rule
    keyed = F.col("rule_id").isin(*guidance.RULE_PATTERNS)
    rows = rules.join(F.broadcast(found), "rule_id", "left")
    empty = F.array().cast(MATCH)
    matches = F.coalesce(F.transform("m", lambda x: x.dropFields("match_no")).cast(MATCH), empty)
    status = F.when(~keyed, NOT_EVALUATED).when(F.size(matches) > 0, guidance.OBSERVED).otherwise(guidance.MISSING)
    rows = rows.select("rule_id", "source_id", "exact_excerpt", status.alias("evaluation_status"), F.when(keyed, BY_KEYWORDS).otherwise(BY_HUMANS).alias("evaluation_method"), F.when(keyed, matches).alias("evidence_matches"))
    if texts is None:
        return rows.withColumn("source_anchor", F.lit(None).cast(ANCHOR)).drop("source_id", "exact_excerpt")
    excerpts = rows.join(texts, "source_id").select(F.col("rule_id").alias("excerpt_id"), F.col("exact_excerpt").alias("excerpt"), "text")
    places = guidance.anchors(excerpts).withColumnRenamed("excerpt_id", "rule_id")
    rows = rows.join(texts.select("source_id", "md_path"), "source_id", "left").join(places, "rule_id", "left")
    anchor = F.struct("md_path", "char_offset", "line_number", "page_anchor", "preview", "matched_via").cast(ANCHOR)
    return rows.withColumn("source_anchor", F.when(F.col("char_offset").isNotNull(), anchor)).select("rule_id", "evaluation_status", "evaluation_method", "evidence_matches", "source_anchor")


def _prompt() -> Column:
    modal = F.when(F.coalesce("modal_strength", F.lit("")) != "", F.concat(F.lit(" ("), "modal_strength", F.lit(")"))).otherwise("")
    base = F.concat(F.lit("Confirm whether the "), F.coalesce("target_document_type", F.lit("target document")), F.lit(" satisfies this rule"), modal, F.lit(": "), F.trim(F.coalesce("paraphrase", F.lit(""))))
    return F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.concat(base, F.lit("\n\nReviewer notes: "), F.trim("notes"))).otherwise(base)


def review_items(rules: DataFrame, found: DataFrame, run_id: str | None = None) -> DataFrame:
    """An item per rule in the order of ``pos``: the rule's fields, a prompt, what to look at, and the evaluation ``found``."""
    missing = F.coalesce("evaluation_status", F.lit(NOT_EVALUATED)).alias("evaluation_status"), F.coalesce("evaluation_method", F.lit(BY_HUMANS)).alias("evaluation_method")
    pointer = F.struct("target_document_type", "source_id", "source_excerpt_pending", "exact_excerpt", "source_hash", "source_url_or_local_path", "source_version", F.lit(run_id).cast("string").alias("verify_run_id"))
    shown = [f for f in RULE_FIELDS if f not in ("paraphrase", "notes")]
    return rules.join(found, "rule_id", "left").select("pos", *shown, "source_excerpt_pending", F.lit(TO_CONFIRM).alias("review_status"), _prompt().alias("review_prompt"), pointer.alias("evidence_to_review"), *missing, "evidence_matches", "source_anchor", F.lit(BOUNDARY).alias("output_boundary"))


def run_reference(report: dict | None) -> dict | None:
    """Run id and counts of an earlier report, null where it has none."""
    if report is None:
        return None
    counts = report.get("artifact_counts") or {}
    return {"run_id": report.get("run_id"), **{f"n_{name}": counts.get(name, report.get(f"n_{name}")) for name in RUN_FIELDS}}


def markdown(items: Iterator[dict], pack: dict, n_items: int, run: dict | None) -> Iterator[str]:
    """The review list as lines of Markdown."""
    yield from (f"# {pack.get('document_family') or '<unknown>'} review checklist", "", f"- **Pack:** `{pack.get('pack_id') or '<unknown>'}` v{pack.get('pack_version') or '<unknown>'} ({pack.get('pack_status') or '<unknown>'})", f"- **Review items:** {n_items}", f"- **Output boundary:** {BOUNDARY}", f"- **Default status:** `{TO_CONFIRM}`", "", "## Run", "")
    if run:
        yield from ("| Field | Value |", "|---|---|", *(f"| `{k}` | {v} |" for k, v in run.items() if v is not None), "")
    else:
        yield from ("(no run referenced)", "")
    yield from ("## Review items", "")
    hidden = {"pos", "rule_id", "exact_excerpt", "review_prompt", "evidence_to_review", "evidence_matches", "source_anchor"}
    for k, item in enumerate(items, 1):
        yield from (f"### {k}. `{item['rule_id']}`", "", "| Field | Value |", "|---|---|", *(f"| `{f}` | `{v}` |" for f, v in item.items() if f not in hidden and v is not None), "")
        if (item["exact_excerpt"] or "").strip():
            yield from ("**Source excerpt**", "", item["exact_excerpt"].strip(), "")
        if anchor := item["source_anchor"]:
            page = f", page {anchor['page_anchor']}" if anchor["page_anchor"] is not None else ""
            context = next((line.strip() for line in anchor["preview"].split("\n") if line.strip()), "")
            yield from ("**Source anchor**", "", f"- File: `{anchor['md_path']}` (line {anchor['line_number']}{page}, matched via `{anchor['matched_via']}`)", f"- Context: {context[:200]}", "")
        if item["evidence_matches"]:
            yield from ("**Evidence matches**", "", *(f"- `{m['span_id']}` of `{m['document_id']}`, pattern `{m['matched_pattern']}`: {m['span_text_preview']}" for m in item["evidence_matches"]), "")
        yield from ("**Review prompt**", "", item["review_prompt"], "")


def page_texts(pages: DataFrame, spec: Column) -> DataFrame:
    """``pages`` (page, text and others) that a ``spec`` such as "1,3-5" names, in order; null or blank names all."""
    parts = F.transform(F.split(spec, ","), lambda p: F.split(F.trim(p), "-"))
    ranges = F.transform(parts, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("int").alias("a"), F.try_element_at(p, F.lit(-1)).try_cast("int").alias("b")))
    named = F.exists(ranges, lambda r: F.col("page").between(r["a"], r["b"]))
    return pages.where(F.coalesce(F.trim(spec) == "", F.lit(True)) | named)
